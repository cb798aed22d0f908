"""Call graphs: building nodes and edges from extracted symbols, reachability, lookups and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryflow.functions.scalar import first_url_segment, last_segment
from quarryflow.sources.scratch import Scratch

#: Node types of the layers that can be called, in the order of a call chain.
LAYER_NODE = {"CONTROLLER": "CONTROLLER_METHOD", "SERVICE_INTERFACE": "SERVICE_METHOD", "SERVICE_IMPL": "IMPL_METHOD", "MAPPER": "MAPPER_METHOD"}
CALLING = ("CONTROLLER", "SERVICE_IMPL")


def node_type(layer: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LAYER_NODE.items():
        out = F.when(layer == k, F.lit(v)).otherwise(out)
    return out


def method_id(layer: Column, class_name: Column, method: Column) -> Column:
    """Overloads share an id."""
    return F.concat(node_type(layer), F.lit("::"), class_name, F.lit("."), method)


def _methods(classes: DataFrame) -> DataFrame:
    kept = classes.where(F.col("layer").isin(*LAYER_NODE))
    rows = kept.select("package", "class_name", "layer", "file_path", "injected_fields", "implements", F.posexplode("methods").alias("at", "m"))
    return rows.select("*", F.col("m.method_name").alias("method_name"), method_id(F.col("layer"), F.col("class_name"), F.col("m.method_name")).alias("id"))


def sql_id(statements_alias: str = "") -> Column:
    p = f"{statements_alias}." if statements_alias else ""
    return F.concat(F.lit("SQL::"), F.coalesce(F.col(f"{p}namespace"), F.lit("")), F.lit("."), F.col(f"{p}sql_id"))


def resolve_calls(classes: DataFrame) -> DataFrame:
    """Every call of a controller or implementation method: src_id, receiver, method, line, target (an id or null),
    outcome (resolved, ignored or unresolved) and reason. A receiver is the class itself, an injected field's type, or a
    service, implementation or mapper class named like it."""
    calls = _methods(classes).where(F.col("layer").isin(*CALLING)).select("id", "class_name", "injected_fields", F.posexplode("m.calls").alias("nth", "c"))
    calls = calls.select(F.col("id").alias("src_id"), "nth", F.col("class_name").alias("own"), F.col("c.receiver").alias("receiver"), F.col("c.method_name").alias("method"), F.col("c.line").alias("line"), F.filter("injected_fields", lambda f: f["field_name"] == F.col("c.receiver")).alias("fields"))
    known = classes.groupBy("class_name").agg(F.max("layer").alias("layer"), F.max(F.transform("methods", lambda m: m["method_name"])).alias("names"))
    self_call = F.col("receiver").isNull() | (F.col("receiver") == "this")
    named = F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))
    typed = F.get("fields", F.lit(0))["field_type"]
    step = calls.select("*", F.when(self_call, F.col("own")).otherwise(typed).alias("typed"), named.alias("named"), self_call.alias("self_call"))
    by_name = known.where(F.col("layer").isin("SERVICE_INTERFACE", "SERVICE_IMPL", "MAPPER")).select(F.col("class_name").alias("named"), F.lit(True).alias("is_named"))
    step = step.join(by_name, "named", "left").withColumn("target_class", F.coalesce("typed", F.when(F.col("is_named"), F.col("named"))))
    step = step.join(known.withColumnRenamed("class_name", "target_class"), "target_class", "left")
    target = method_id(F.col("layer"), F.col("target_class"), F.col("method"))
    callable_ = F.col("layer").isin(*LAYER_NODE)
    known_method = F.array_contains("names", F.col("method"))
    outcome = (
        F.when(F.col("target_class").isNull(), "ignored")
        .when(F.col("layer").isNull(), "unresolved")
        .when(~callable_, "ignored")
        .when(~known_method, "unresolved")
        .when(target == F.col("src_id"), "ignored")
        .otherwise("resolved")
    )
    reason = F.when(F.col("target_class").isNotNull() & F.col("layer").isNull(), "unknown class").when(callable_ & ~known_method, "unknown method")
    return step.select("src_id", "nth", "receiver", "method", "line", F.when(outcome == "resolved", target).alias("target"), outcome.alias("outcome"), F.when(outcome == "unresolved", reason).alias("reason"))


def build_graph(classes: DataFrame, statements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges (repeats kept) and the calls they were resolved from."""
    methods = _methods(classes)
    last = methods.groupBy("id").agg(F.max_by(F.struct("layer", "class_name", "method_name", "file_path", "m"), F.struct("file_path", "at")).alias("x"))
    label = F.concat("x.class_name", F.lit("."), "x.method_name")
    nodes = last.select("id", node_type(F.col("x.layer")).alias("node_type"), F.col("x.class_name").alias("class_name"), F.col("x.method_name").alias("method_name"), F.col("x.file_path").alias("file_path"), F.col("x.m.start_line").alias("start_line"), F.col("x.m.end_line").alias("end_line"), label.alias("label"), F.col("x.m.leading_comment").alias("summary"))
    urls = methods.where((F.col("layer") == "CONTROLLER") & F.col("m.url").isNotNull()).select(F.col("m.url").alias("url"), "id", F.struct("file_path", "at").alias("place"), F.col("m.leading_comment").alias("summary"))
    none, no_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    url_nodes = urls.groupBy("url").agg(F.min_by("summary", "place").alias("summary")).select(F.concat(F.lit("URL::"), "url").alias("id"), F.lit("URL").alias("node_type"), none.alias("class_name"), none.alias("method_name"), none.alias("file_path"), no_int.alias("start_line"), no_int.alias("end_line"), F.col("url").alias("label"), "summary")
    sqls = statements.select(sql_id().alias("id"), F.lit("SQL").alias("node_type"), last_segment("namespace").alias("class_name"), F.col("sql_id").alias("method_name"), "file_path", "start_line", "end_line", F.concat(last_segment("namespace"), F.lit("."), "sql_id").alias("label"), F.col("sql_type").alias("summary"))
    refs = statements.select(sql_id().alias("src_id"), F.explode("referenced_tables").alias("t"))
    tables = refs.select("t").distinct().select(F.concat(F.lit("TABLE::"), "t").alias("id"), F.lit("TABLE").alias("node_type"), none.alias("class_name"), none.alias("method_name"), none.alias("file_path"), no_int.alias("start_line"), no_int.alias("end_line"), F.col("t").alias("label"), none.alias("summary"))
    calls = resolve_calls(classes)
    mapper = methods.where(F.col("layer") == "MAPPER").select("id", F.concat_ws(".", "package", "class_name").alias("namespace"), F.col("method_name").alias("sql_id"))
    executes = mapper.join(statements.select("namespace", "sql_id", sql_id().alias("dst_id")), ["namespace", "sql_id"]).select(F.col("id").alias("src_id"), "dst_id", F.lit("EXECUTES").alias("edge_type"))
    own = methods.where(F.col("layer") == "SERVICE_INTERFACE").select("id", F.col("class_name").alias("iface"), "method_name").distinct()
    impls = methods.where(F.col("layer") == "SERVICE_IMPL").select("id", "method_name", F.explode("implements").alias("iface")).distinct()
    implements = own.alias("a").join(impls.alias("b"), ["iface", "method_name"]).select(F.col("a.id").alias("src_id"), F.col("b.id").alias("dst_id"), F.lit("IMPLEMENTS").alias("edge_type"))
    edges = (
        urls.select(F.concat(F.lit("URL::"), "url").alias("src_id"), F.col("id").alias("dst_id"), F.lit("HANDLES").alias("edge_type"))
        .unionByName(calls.where("outcome = 'resolved'").select("src_id", F.col("target").alias("dst_id"), F.lit("CALLS").alias("edge_type")))
        .unionByName(implements)
        .unionByName(executes)
        .unionByName(refs.select("src_id", F.concat(F.lit("TABLE::"), "t").alias("dst_id"), F.lit("REFERENCES").alias("edge_type")))
    )
    return nodes.unionByName(url_nodes).unionByName(sqls).unionByName(tables), edges, calls


# Reachability


#: Rounds of a walk that are kept as tables of their own before they are put together.
LEVELS = 8
#: The first rounds go step by step, which is all that a shallow graph needs; then steps are doubled while that makes at
#: most so many rows for each edge.
PLAIN, GROWTH = 4, 8


def _doubled(jump: DataFrame, single: bool, most: int, scratch: Scratch, name: str) -> DataFrame | None:
    """Pairs (id, next) twice as far apart, or None if a walk through a node in the middle makes too many of them. single:
    no id has two of them, so that there are never more, nor any repeated."""
    first, second = jump.select("id", F.col("next").alias("mid")), jump.select(F.col("id").alias("mid"), "next")
    pairs = first.join(second, "mid").select("id", "next")
    if single:
        return scratch.write(pairs, name)
    into = jump.groupBy(F.col("next").alias("id")).agg(F.count(F.lit(1)).alias("ins"))
    out = jump.groupBy("id").agg(F.count(F.lit(1)).alias("outs"))
    walks = into.join(out, "id").agg(F.coalesce(F.sum(F.col("ins") * F.col("outs")), F.lit(0))).first()[0]
    return scratch.write(pairs.distinct(), name) if walks <= most else None


def closure(edges: DataFrame, starts: DataFrame, reverse: bool = False, growth: int = GROWTH) -> DataFrame:
    """(start, id) for every node reachable from each start, itself included. starts: id. All starts go in one pass.

    Nodes that lead nowhere are left out of the walk and reached by one last step. After some single steps rounds double:
    when every node closer than m steps is known, pairs of nodes that are s <= m steps apart lead to those closer than
    m + s, and joined with themselves they are 2 s steps apart. A path of n nodes needs about PLAIN + log2(n) rounds, and
    each makes no more pairs than there are edges. Where paths multiply, joining pairs would make ever more of them; when it
    would make more than `growth` rows an edge, steps stay as long as they are and the walk goes on from the newest nodes. A
    round that finds nothing new ends it, so cycles end too: distances have no gaps."""
    scratch = Scratch(edges.sparkSession, "closure")
    a, b = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    steps = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
    steps = scratch.write(steps, "steps")
    leading = steps.select(F.col("id").alias("next"), F.lit(True).alias("inner")).distinct()
    steps = scratch.write(steps.join(leading, "next", "left").select("id", "next", F.col("inner").isNotNull().alias("inner")), "sorted")
    jump, last = steps.where("inner").drop("inner"), steps.where("NOT inner").drop("inner")
    n, fan = jump.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    most = growth * n + 10_000
    newest = scratch.write(starts.select(F.col("id").alias("start"), "id").distinct(), "level0")
    levels, k, doubled, apart = [newest], 0, False, True
    while True:
        k += 1
        known = reduce(DataFrame.union, levels) if doubled else newest
        found = known.join(jump, "id").select("start", F.col("next").alias("id")).distinct()
        for seen in levels:
            found = found.join(seen, ["start", "id"], "left_anti")
        newest = scratch.write(found, f"level{k}")
        if newest.isEmpty():
            reached = reduce(DataFrame.union, levels)
            return reached.union(reached.join(last, "id").select("start", F.col("next").alias("id")).distinct())
        levels.append(newest)
        if len(levels) > LEVELS:
            levels = [scratch.write(reduce(DataFrame.union, levels), f"seen{k}")]
        further = _doubled(jump, fan <= 1, most, scratch, f"jump{k}") if apart and k >= PLAIN else None
        doubled, apart = further is not None, apart and (k < PLAIN or further is not None)
        jump = jump if further is None else further


def subgraph(nodes: DataFrame, edges: DataFrame, start: str, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes reachable from start and all edges that leave them in the walking direction, repeats kept."""
    reached = closure(edges, nodes.sparkSession.createDataFrame([(start,)], "id string"), reverse).select("id")
    return nodes.join(reached, "id", "left_semi"), edges.join(reached.withColumnRenamed("id", "dst_id" if reverse else "src_id"), "dst_id" if reverse else "src_id", "left_semi")


def chain(nodes: DataFrame, edges: DataFrame, url: str) -> tuple[bool, DataFrame, DataFrame]:
    """Whether the URL is known, and its downstream graph (empty if not)."""
    start = f"URL::{url}"
    found = not nodes.where(F.col("id") == start).isEmpty()
    kept, left = subgraph(nodes, edges, start)
    return found, kept if found else kept.limit(0), left if found else left.limit(0)


def full_chain(nodes: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """Downstream and upstream together; nodes and edges once each."""
    down, up = subgraph(nodes, edges, node), subgraph(nodes, edges, node, reverse=True)
    return down[0].unionByName(up[0]).dropDuplicates(["id"]), down[1].unionByName(up[1]).dropDuplicates(["src_id", "dst_id", "edge_type"])


def expand(nodes: DataFrame, edges: DataFrame, node: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes at most depth steps away in either direction, and the edges walked; the centre always belongs."""
    both = edges.select(F.col("src_id").alias("id"), F.col("dst_id").alias("next")).union(edges.select("dst_id", "src_id"))
    seen = edges.sparkSession.createDataFrame([(node,)], "id string")
    walked = edges.limit(0)
    for _ in range(max(depth, 0)):
        touching = edges.join(seen.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(*edges.columns).unionByName(edges.join(seen.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(*edges.columns))
        walked = walked.unionByName(touching)
        seen = seen.union(both.join(seen, "id", "left_semi").select(F.col("next"))).distinct()
    return nodes.join(seen, "id", "left_semi"), walked.dropDuplicates(["src_id", "dst_id", "edge_type"])


# Lookups and statistics


def node_by_symbol(nodes: DataFrame, class_name: str, method_name: str) -> DataFrame:
    return nodes.where((F.col("class_name") == class_name) & (F.col("method_name") == method_name)).orderBy("id").limit(1)


def sqls_by_table(nodes: DataFrame, edges: DataFrame, table: str) -> DataFrame:
    into = edges.where((F.col("edge_type") == "REFERENCES") & (F.col("dst_id") == f"TABLE::{table}"))
    return nodes.join(into.select(F.col("src_id").alias("id")), "id")


def list_urls(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type") == "URL").orderBy("label")


def urls_by_domain(nodes: DataFrame) -> DataFrame:
    urls = nodes.where(F.col("node_type") == "URL")
    return urls.groupBy(first_url_segment("label").alias("domain")).agg(F.array_sort(F.collect_list("label")).alias("urls"))


def downstream_tables(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """id, tables: sorted labels of the tables that each start reaches, for all starts in one pass."""
    reached = closure(edges, starts).join(nodes.where(F.col("node_type") == "TABLE").select("id", "label"), "id")
    tables = reached.groupBy(F.col("start").alias("id")).agg(F.array_sort(F.collect_set("label")).alias("tables"))
    return starts.select("id").join(tables, "id", "left").select("id", F.coalesce("tables", F.array().cast("array<string>")).alias("tables"))


def graph_stats(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(metric, value): nodes and edges by type, calls by outcome, ratio of unresolved to attempted calls."""
    n = nodes.groupBy(F.concat(F.lit("nodes:"), "node_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    e = edges.groupBy(F.concat(F.lit("edges:"), "edge_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    c = calls.groupBy(F.concat(F.lit("calls:"), "outcome").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    tried, failed = F.sum((F.col("outcome") != "ignored").cast("int")), F.sum((F.col("outcome") == "unresolved").cast("int"))
    ratio = calls.agg(F.coalesce(F.when(tried > 0, failed / tried), F.lit(0.0)).alias("value")).select(F.lit("unresolved_ratio").alias("metric"), "value")
    return n.unionByName(e).unionByName(c).unionByName(ratio)
