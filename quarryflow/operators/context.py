"""Context assembly: tiers, summaries, a greedy character budget, prompts and manuals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryflow.functions.scalar import sorted_join
from quarryflow.sources.scratch import Scratch

from .graph import closure

#: The budget (tokens times characters a token), tiers, node types with code, labels, order of a chain.
BUDGET = 5000 * 2
HIT, DOWNSTREAM, UPSTREAM, OTHER = 2, 3, 4, 5
CODE_NODES = ("CONTROLLER_METHOD", "IMPL_METHOD", "SQL")
LABELS = {"CONTROLLER_METHOD": "Controller", "IMPL_METHOD": "ServiceImpl", "SQL": "SQL", "ETC_REF": "상수/코드정의"}
CHAIN_ORDER = ("URL", "CONTROLLER_METHOD", "SERVICE_METHOD", "IMPL_METHOD", "MAPPER_METHOD")
CONSTANT = r"\b([A-Z][A-Za-z0-9]*)\.[A-Z]"
CONSTANT_LINES = 40
SEPARATOR = "\n\n---\n\n"
#: The wording of a chain's summary.
FLOW, TABLES_OPEN, TABLES_CLOSE, NOTHING = "처리 흐름: ", "테이블(", ")", "처리 흐름: 관련 코드를 찾지 못했습니다."
ARROW = " → "
#: Kinds of nodes that a summary names, in its order, and what stands between the names of one kind.
NAMED = (("URL", " / "), ("CONTROLLER_METHOD", " / "), ("IMPL_METHOD", " / "), ("TABLE", ", "))
_BETWEEN = "CASE kind " + " ".join(f"WHEN {n} THEN '{by}'" for n, (_, by) in enumerate(NAMED)) + " END"
#: Ids or labels in a piece of what a question reaches, about.
PIECE = 4096


def candidate_tiers(edges: DataFrame, hits: DataFrame, expanded: int = 3) -> DataFrame:
    """id, tier: the least tier of each node among hits, what the first `expanded` hits reach, and what reaches them.
    hits: id, rank (from 1). Walking down and up again gives the nodes around both, in tier OTHER."""
    chosen = hits.where(F.col("rank") <= expanded).select("id")
    tagged = lambda df, tier: df.select("id", F.lit(tier).alias("tier"))
    all_of = tagged(hits, HIT).unionByName(tagged(closure(edges, chosen), DOWNSTREAM)).unionByName(tagged(closure(edges, chosen, reverse=True), UPSTREAM))
    return all_of.groupBy("id").agg(F.min("tier").alias("tier"))


def _chained(parts: list[Column]) -> Column:
    """The summary of the joined names of each kind of NAMED; null and empty ones are left out."""
    filled = [F.nullif(p, F.lit("")) for p in parts]
    chained = F.concat_ws(ARROW, *filled[:3], F.concat(F.lit(TABLES_OPEN), filled[3], F.lit(TABLES_CLOSE)))
    return F.when(chained != "", F.concat(F.lit(FLOW), chained)).otherwise(F.lit(NOTHING))


def chain_summary(nodes: DataFrame) -> DataFrame:
    """One row, summary: URLs, controllers, implementations, then tables, each sorted and once."""
    part = lambda kind, by: sorted_join(F.collect_set(F.when(F.col("node_type") == kind, F.col("label"))), by)
    parts = nodes.agg(*(part(kind, by).alias(f"p{n}") for n, (kind, by) in enumerate(NAMED)))
    return parts.select(_chained([F.col(f"p{n}") for n in range(len(NAMED))]).alias("summary"))


def question_groups(hits: DataFrame) -> DataFrame:
    """q, g: the least question with the same hits, which stands for all of them. hits: q, id, rank."""
    same = hits.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("same"))
    return same.join(same.groupBy("same").agg(F.min("q").alias("g")), "same").select("q", "g")


def around(edges: DataFrame, hits: DataFrame, expanded: int = 3) -> DataFrame:
    """start, tier, id: each hit, and what it reaches and what reaches it if it is among the first `expanded` of a question.
    Both ways are one walk, through nodes that are marked with the way. hits: g, id, rank (from 1)."""
    marked = lambda way, a, b: edges.select(F.concat(F.lit(way), a).alias("src_id"), F.concat(F.lit(way), b).alias("dst_id"))
    starts = hits.where(F.col("rank") <= expanded).select("id").distinct()
    starts = starts.select(F.explode(F.array(F.concat(F.lit(">"), "id"), F.concat(F.lit("<"), "id"))).alias("id"))
    walked = closure(marked(">", "src_id", "dst_id").union(marked("<", "dst_id", "src_id")), starts)
    tier = F.when(F.col("start").startswith(">"), DOWNSTREAM).otherwise(UPSTREAM)
    own = hits.select(F.col("id").alias("start"), F.lit(HIT).alias("tier"), "id").distinct()
    return own.union(walked.select(F.expr("substring(start, 2)"), tier, F.expr("substring(id, 2)")))


def asked_starts(hits: DataFrame, reached: DataFrame, expanded: int = 3) -> DataFrame:
    """g, start, tier, wide: which rows of `around` are a question's, and whether they are too many for one piece."""
    ways = F.when(F.col("rank") <= expanded, F.array(*map(F.lit, (HIT, DOWNSTREAM, UPSTREAM)))).otherwise(F.array(F.lit(HIT)))
    own = hits.select("g", F.col("id").alias("start"), F.explode(ways).alias("tier"))
    sizes = reached.groupBy("start", "tier").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("g"))  # of at most three rows a hit
    return own.join(sizes, ["start", "tier"]).select("g", "start", "tier", (total > PIECE).alias("wide"))


def pieces(asked: DataFrame, reached: DataFrame, items: DataFrame, kind: tuple[str, ...] = ()) -> DataFrame:
    """piece (a number), start, tier, wide, kind, chunk, values: what each start reaches, as arrays: one a chunk for wide
    questions, a single one for the others. items: id, kind, chunk, value."""
    needed = asked.select("start", "tier", "wide").distinct()
    rows = reached.join(items, "id").join(needed, ["start", "tier"]).withColumn("chunk", F.when(F.col("wide"), F.col("chunk")).otherwise(0))
    made = rows.groupBy("start", "tier", "wide", *kind, "chunk").agg(F.collect_set("value").alias("values"))
    return made.withColumn("piece", F.monotonically_increasing_id())


def pieces_of(asked: DataFrame, made: DataFrame, kind: tuple[str, ...] = ()) -> DataFrame:
    """g, kind, chunk, tier, values. Rows meet by piece and not by start, so a start that many wide questions share is dealt
    to as many tasks as it has pieces. made: `pieces`, written."""
    wanted = asked.join(made.drop("values"), ["start", "tier", "wide"]).select("g", *kind, "chunk", "tier", "piece")
    return wanted.join(made.select("piece", "values"), "piece").drop("piece")


def tiers_of(asked: DataFrame, made: DataFrame) -> DataFrame:
    """g, sets: arrays of (tier, ids) of a chunk, each id once, in its least tier."""
    parts = pieces_of(asked, made).groupBy("g", "chunk").agg(F.collect_list(F.struct("tier", "values")).alias("parts"))
    of = lambda tier: F.array_distinct(F.flatten(F.transform(F.filter("parts", lambda p: p["tier"] == tier), lambda p: p["values"])))
    sets = parts.select("g", of(HIT).alias("hit"), of(DOWNSTREAM).alias("down"), of(UPSTREAM).alias("up"))
    sets = sets.withColumn("down", F.array_except("down", "hit")).withColumn("up", F.array_except(F.array_except("up", "hit"), "down"))
    named = ((HIT, "hit"), (DOWNSTREAM, "down"), (UPSTREAM, "up"))
    return sets.select("g", F.array(*(F.struct(F.lit(tier).alias("tier"), F.col(c).alias("ids")) for tier, c in named)).alias("sets"))


def each_id(sets: DataFrame) -> DataFrame:
    """The other columns, tier, id of the rows of `tiers_of`."""
    rest = [c for c in sets.columns if c != "sets"]
    return sets.select(*rest, F.inline("sets")).select(*rest, "tier", F.explode("ids").alias("id"))


def names(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """id, kind, chunk, value: labels of the nodes that summaries name, in chunks of the sorted labels of a kind."""
    kind = F.array_position(F.array(*(F.lit(name) for name, _ in NAMED)), F.col("node_type")) - 1
    rows = nodes.select("id", kind.alias("kind"), F.col("label").alias("value")).where("kind >= 0 AND value IS NOT NULL")
    order = rows.select("kind", "value").distinct().repartitionByRange("kind", "value").sortWithinPartitions("kind", "value")
    order = order.withColumn("nth", F.monotonically_increasing_id())  # the partition above 33 bits of the row
    chunk = F.shiftleft(F.shiftright("nth", 33), 32) + F.floor((F.col("nth") % (1 << 33)) / PIECE)
    return rows.join(scratch.write(order.select("kind", "value", chunk.alias("chunk")), "labels"), ["kind", "value"])


def summary_parts(asked: DataFrame, made: DataFrame, texts: bool) -> DataFrame:
    """g, kind, chunk, chars, and text if asked for: the names of a chunk, each once, in the text sorted and joined."""
    values = F.array_distinct(F.flatten(F.collect_list("values")))
    rows = pieces_of(asked, made, ("kind",)).groupBy("g", "kind", "chunk").agg(values.alias("values"))
    if texts:
        rows = rows.withColumn("text", F.expr(f"array_join(array_sort(values), {_BETWEEN})"))
        return rows.select("g", "kind", "chunk", F.length("text").alias("chars"), "text")
    return rows.select("g", "kind", "chunk", F.expr(f"length(array_join(values, {_BETWEEN}))").alias("chars"))


def chain_summaries(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """g, used, and summary if the parts have texts, of all groups (g). used: the summary's length, from the parts' lengths."""
    of = lambda n: F.col("kind") == n
    kinds = [(n, by) for n, (_, by) in enumerate(NAMED)]
    aggs = [(F.sum(F.when(of(n), F.col("chars") + len(by))) - len(by)).alias(f"n{n}") for n, by in kinds]
    if "text" in parts.columns:
        aggs.append(F.sort_array(F.collect_list(F.struct("kind", "chunk", "text"))).alias("parts"))
    rows = groups.join(parts.groupBy("g").agg(*aggs), "g", "left")
    filled = [F.nullif(F.col(f"n{n}"), F.lit(0)) for n, _ in kinds]
    filled[3] = filled[3] + len(TABLES_OPEN + TABLES_CLOSE)
    total = sum((F.coalesce(c, F.lit(0)) + F.when(c.isNull(), 0).otherwise(len(ARROW)) for c in filled), F.lit(0))
    used = F.when(total > 0, total - len(ARROW) + len(FLOW)).otherwise(len(NOTHING)).cast("long").alias("used")
    if "text" not in parts.columns:
        return rows.select("g", used)
    texts = lambda n, by: F.array_join(F.transform(F.filter("parts", lambda p: p["kind"] == n), lambda p: p["text"]), by)
    return rows.select("g", used, _chained([texts(n, by) for n, by in kinds]).alias("summary"))


def call_chain(nodes: DataFrame) -> DataFrame:
    """label of the nodes of a chain without statements and tables, by layer and name."""
    rank = F.array_position(F.array(*map(F.lit, CHAIN_ORDER)), F.col("node_type"))
    return nodes.where(F.col("node_type").isin(*CHAIN_ORDER)).orderBy(rank, "label").select("label")


def constant_classes(code: DataFrame, classes: DataFrame) -> DataFrame:
    """Small classes of no layer that the code (column text) refers to by Name.Something."""
    names = code.select(F.explode(F.regexp_extract_all("text", F.lit(CONSTANT), F.lit(1))).alias("class_name")).distinct()
    small = classes.where((F.col("layer") == "ETC") & (F.col("end_line") - F.col("start_line") + 1 <= CONSTANT_LINES))
    return small.join(names, "class_name", "left_semi")


def block_label(node_type: Column, class_name: Column, method_name: Column) -> Column:
    return F.when(node_type == "ETC_REF", class_name).otherwise(F.concat_ws(".", class_name, method_name))


def block(file_path: Column, start: Column, end: Column, node_type: Column, label: Column, code: Column) -> Column:
    kind = F.lit(None).cast("string")
    for k, v in LABELS.items():
        kind = F.when(node_type == k, F.lit(v)).otherwise(kind)
    return F.concat(F.lit("["), file_path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("] "), kind, F.lit("/"), label, F.lit("\n"), code)


def pack(blocks: DataFrame, group: str, order: list[str], size: Column, budget: int = BUDGET, used: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """group, the order columns, carry, size, kept, used of every block. In order, a block is kept if it still fits; one
    that does not is skipped and later, smaller ones may fit, so this is a fold over each group's sorted blocks and not
    a running sum. A group is one question's candidates; its blocks stream past in order, and only the sum is held."""
    start = (used if used is not None else F.lit(0)).cast("long")
    rows = blocks.select(group, *order, *carry, size.cast("long").alias("size"), start.alias("__start"))
    rows = rows.repartition(group).sortWithinPartitions(group, *order, *carry)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for batch in batches:
            kept, after = [], []
            for key, n, first in zip(*(batch.column(c).to_pylist() for c in (group, "size", "__start"))):
                if key != last:
                    last, total = key, first
                kept.append(total + n <= budget)
                total += n if kept[-1] else 0
                after.append(total)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.bool_()), pa.array(after, pa.int64())], names=[*batch.schema.names[:-1], "kept", "used"])

    out = T.StructType([*rows.schema.fields[:-1], T.StructField("kept", T.BooleanType()), T.StructField("used", T.LongType())])
    return rows.mapInArrow(fold, out)


#: Rows of a group that one round folds; rows of a range, about.
CHUNK, RANGE = 20_000, 200_000


def pack_parallel(
    blocks: DataFrame, group: str, order: list[str], size: Column, budget: int = BUDGET, used: Column | None = None, carry: tuple[str, ...] = (), chunk: int = CHUNK
) -> DataFrame:
    """What `pack` returns, for groups of any size: no task sees a group as a whole.

    Rows are dealt by ranges of (group, order) and numbered. What is left of a budget only shrinks, so a row larger than
    it never fits again. A round looks, for each group, at the next `chunk` rows that still fit what is left, folds only
    those, and goes on behind them; it ends for a group when there are fewer or nothing is left. `used` is a prefix sum
    over the kept rows: within each range, then over the ranges' totals."""
    scratch = Scratch(blocks.sparkSession, "pack")
    start = (used if used is not None else F.lit(0)).cast("long")
    rows = blocks.select(F.struct(F.col(group).alias("g")).alias("__key"), *order, *carry, size.cast("long").alias("size"), start.alias("__start"))
    by = ["__key", *order, *carry, "size"]
    ranges = max(1, -(-rows.count() // RANGE))
    placed = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("__pos", F.monotonically_increasing_id())
    placed = scratch.write(placed, "placed")
    state = scratch.write(placed.groupBy("__key").agg((F.lit(budget) - F.min("__start")).alias("left"), F.lit(-1).cast("long").alias("after")), "state0")
    narrow, kept, k = placed.select("__key", "__pos", "size").where("size > 0"), None, 0
    while not state.isEmpty():
        k += 1
        fits = narrow.join(state, "__key").where("__pos > after AND size <= left")
        some = _nearest(fits, chunk, scratch, k)
        folded = scratch.write(some.repartition("__key").sortWithinPartitions("__key", "__pos").mapInArrow(_fold_left, some.schema.add("kept", "boolean")), f"folded{k}")
        ended = folded.groupBy("__key").agg(F.max_by("left", "__pos").alias("left"), F.max("__pos").alias("after"), F.count(F.lit(1)).alias("n"))
        state = scratch.write(ended.where((F.col("n") == chunk) & (F.col("left") > 0)).select("__key", "left", "after"), f"state{k}")
        now = folded.where("kept").select("__pos", F.lit(True).alias("__fits"))
        kept = now if kept is None else kept.unionByName(now)
    part = F.shiftright("__pos", 33)  # of the range
    marked = placed.join(kept, "__pos", "left") if kept is not None else placed.withColumn("__fits", F.lit(None).cast("boolean"))
    empty = (F.col("size") == 0) & (F.col("__start") <= budget)
    marked = marked.withColumn("kept", F.coalesce("__fits", empty)).withColumn("__part", part).repartition(ranges, "__key", "__part")
    own = Window.partitionBy("__key", "__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.when(F.col("kept"), F.col("size")).otherwise(0)
    marked = scratch.write(marked.withColumn("used", F.col("__start") + F.sum(taken).over(own)), "marked")
    totals = marked.groupBy("__key", "__part").agg(F.sum(taken).alias("total"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__key", "__part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    whole = marked.join(before, ["__key", "__part"])
    return whole.select(F.col("__key.g").alias(group), *order, *carry, "size", "kept", (F.col("used") + F.col("before")).alias("used"))


def _nearest(fits: DataFrame, chunk: int, scratch: Scratch, k: int) -> DataFrame:
    """__key, __pos, size, left of the first `chunk` rows of each key: counted a range at a time, so that no task numbers a
    whole group, and only ranges that hold some of these rows are numbered."""
    part = F.shiftright("__pos", 33)
    counts = fits.groupBy("__key", part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("before") < chunk)
    before = scratch.write(before.select("__key", "__part", "before"), f"before{k}")
    own = Window.partitionBy("__key", "__part").orderBy("__pos")
    some = fits.withColumn("__part", part).join(before, ["__key", "__part"]).withColumn("n", F.row_number().over(own))
    return some.where(F.col("n") + F.col("before") <= chunk).select("__key", "__pos", "size", "left")


def _fold_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key and place with what is left before the first of a key: kept, and what is left after each."""
    last, left = object(), 0
    for batch in batches:
        kept, after = [], []
        for key, n, first in zip(*(batch.column(c).to_pylist() for c in ("__key", "size", "left"))):
            if key != last:
                last, left = key, first
            kept.append(n <= left)
            left -= n if kept[-1] else 0
            after.append(left)
        columns = [*(batch.column(c) for c in ("__key", "__pos", "size")), pa.array(after, pa.int64()), pa.array(kept, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["__key", "__pos", "size", "left", "kept"])


def references(packed: DataFrame, code: str = "code") -> DataFrame:
    """What kept blocks show: file, lines, label, first 200 characters of the trimmed code."""
    snippet = F.substring(F.regexp_replace(code, r"^\s+|\s+$", ""), 1, 200)
    return packed.where("kept").select(F.col("file_path").alias("file"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), F.col("label").alias("class_method"), snippet.alias("snippet"))


def context_text(summary: str, blocks: list[str]) -> str:
    return SEPARATOR.join([summary, *blocks])


def is_trivial(methods: DataFrame, group: str, code: str = "code") -> DataFrame:
    """group, trivial: no implementation holds an `if (` or a throw."""
    return methods.groupBy(group).agg(F.bool_and(~F.col(code).rlike(r"\bif\s*\(|\bthrow\b")).alias("trivial"))


def question_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


def diagnose_prompt(log: Column, context: Column) -> Column:
    return F.concat(F.lit("Error log:\n"), log, F.lit("\n\nContext:\n"), context)


def manual_prompt(url: Column, context: Column) -> Column:
    return F.concat(F.lit("Screen or URL:\n"), url, F.lit("\n\nContext:\n"), context, F.lit("\n\nDescribe the steps of this function as a numbered list."))


def sql_prompt(schema: Column, shots: Column, question: Column, today: Column) -> Column:
    return F.concat(F.lit("Schema:\n"), schema, F.lit("\n\nToday: "), today, F.lit(" (this month: "), F.substring(today, 1, 7), F.lit(")\n\nExamples:\n"), shots, F.lit("\n\nQuestion: "), question)


def retry_prompt(prompt: Column, reason: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nThe previous statement failed: "), reason)


#: The wording of a manual entry's chain line.
SQL_COUNT, NO_CHAIN = ("SQL ", "건"), "(호출그래프에서 찾지 못함)"


def manual_rows(nodes: DataFrame, edges: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """url, title, controllers, impls, tables, sql_count, chain_line of every URL, in one pass over all of them. The title
    is that of the handling controller's method, or the method, or the URL; the chain line names that controller, the
    implementations and the number of statements."""
    urls = nodes.where(F.col("node_type") == "URL").select("id", F.col("label").alias("url"))
    reached = closure(edges, urls.select("id")).join(nodes, "id").withColumnRenamed("start", "url_id")
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("node_type") == kind, F.col("label"))))
    handles = edges.where(F.col("edge_type") == "HANDLES").select(F.col("src_id").alias("id"), F.col("dst_id").alias("handler"))
    handlers = handles.join(nodes.select(F.col("id").alias("handler"), "label", "method_name"), "handler").groupBy("id").agg(F.min(F.struct("label", "method_name")).alias("by"))
    rows = reached.groupBy("url_id").agg(pick("CONTROLLER_METHOD").alias("controllers"), pick("IMPL_METHOD").alias("impls"), pick("TABLE").alias("tables"), F.count_if(F.col("node_type") == "SQL").alias("sql_count"))
    named = F.create_map(*(F.lit(x) for pair in (titles or {"": ""}).items() for x in pair))
    method = F.col("by.method_name")
    title = F.coalesce(F.try_element_at(named, method), method, F.col("url"))
    parts = F.concat(F.array_compact(F.array("by.label")), F.col("impls"))
    sqls = F.when(F.col("sql_count") > 0, F.concat(F.lit(ARROW + SQL_COUNT[0]), F.col("sql_count").cast("string"), F.lit(SQL_COUNT[1]))).otherwise("")
    line = F.concat(F.array_join(parts, ARROW), sqls)
    return urls.join(handlers, "id", "left").join(rows, F.col("id") == F.col("url_id")).select("url", title.alias("title"), "controllers", "impls", "tables", "sql_count", F.coalesce(F.nullif(line, F.lit("")), F.lit(NO_CHAIN)).alias("chain_line"))


def appendix(catalog: DataFrame) -> DataFrame:
    """table_name, markdown of every table."""
    row = F.concat(F.lit("| "), "column_name", F.lit(" | "), F.coalesce("data_type", F.lit("")), F.lit(" | "), F.coalesce("column_comment", F.lit("")), F.lit(" |"))
    tables = catalog.groupBy("table_name").agg(F.max("table_comment").alias("comment"), F.array_sort(F.collect_list(F.struct("position", row.alias("row")))).alias("rows"))
    return tables.select("table_name", F.concat(F.lit("### "), "table_name", F.lit(" "), F.coalesce("comment", F.lit("")), F.lit("\n\n| column | type | comment |\n|---|---|---|\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("markdown"))


def assemble_manual(entries: list[dict], domains: list[str], only: str | None = None, appendix_rows: list[str] = ()) -> str:
    """Sections numbered from 2, a domain each, in the given order. An unknown domain raises ValueError."""
    if only is not None and only not in domains:
        raise ValueError(f"unknown domain: {only}")
    out = ["# Manual", "## 1. Overview"]
    out += [f"- {d}: {sum(e['domain'] == d for e in entries)}" for d in domains]
    for n, d in enumerate([d for d in domains if only in (None, d)], 2):
        out.append(f"## {n}. {d}")
        out += [f"### {e.get('title') or e['url']}\n`{e['url']}`\n\n{e['body']}\n\n{e.get('chain_line', '')}".rstrip() for e in entries if e["domain"] == d]
    return "\n\n".join([*out, "## Appendix", *appendix_rows])


def heading_count(content: Column) -> Column:
    """Entries of a manual: headings before the appendix."""
    return F.regexp_count(F.substring_index(content, "## Appendix", 1), F.lit("### "))
