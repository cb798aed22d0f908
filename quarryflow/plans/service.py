"""The service's questions as plans: index a source tree, assemble the context of a question or of a failure, write a
manual. Text generation is a pluggable function; everything before it is deterministic."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryflow.functions.scalar import first_url_segment, line_slice, marked_slice, pagination
from quarryflow.operators import context as C
from quarryflow.operators import ddl, graph, java_source, mapper_xml, stacktrace, vector, vector_index
from quarryflow.operators.relational import Tables
from quarryflow.sources import publish
from quarryflow.sources.files import save_table, with_cached
from quarryflow.sources.scratch import Scratch


@dataclass
class Index:
    files: DataFrame
    classes: DataFrame
    statements: DataFrame
    nodes: DataFrame
    edges: DataFrame
    calls: DataFrame
    catalog: DataFrame
    chunks: DataFrame
    backend: Callable[[list[str]], np.ndarray]
    #: The edges once more, where they are stored by target; else the same as edges.
    incoming: DataFrame | None = None


@dataclass
class Context:
    text: str
    references: list[dict] = field(default_factory=list)
    summary: str = ""
    truncated: bool = False
    chain: list[str] = field(default_factory=list)
    warning: str | None = None
    status: int = 200


#: Tables of a stored index, beside `files`.
STORED = ("classes", "statements", "catalog", "nodes", "edges", "calls", "incoming", "chunks")
#: Columns that stored tables are sorted by: edges by source, and once more by target.
LOOKED_UP_BY = {"nodes": "id", "edges": "src_id", "incoming": "dst_id", "chunks": "node_id"}


def build_index(
    java: DataFrame,
    mappers: DataFrame,
    ddl_text: DataFrame,
    backend: Callable[[list[str]], np.ndarray] = vector.hashed_bag,
    folder: str | None = None,
    progress: Callable[[str, int, int], None] = lambda stage, done, total: None,
) -> Index:
    """java, mappers: path, content; ddl_text: content. Each frame is written once, since every question reads them: as a
    new version below `folder`, which becomes the current one when all of it is there and which `load_index` finds later,
    or for the session only. progress gets the stage, and how many of the stages are done."""
    spark, n, made = java.sparkSession, len(STORED) + 1, {}

    def build(write: Callable[[str, DataFrame], DataFrame]) -> None:
        def stored(name: str, df: DataFrame) -> DataFrame:
            progress(name, (*STORED, "files").index(name), n)
            made[name] = write(name, df)
            return made[name]

        classes, statements = stored("classes", java_source.parse_java(java)), stored("statements", mapper_xml.parse_mappers(mappers))
        stored("catalog", ddl.parse_ddl(ddl_text))
        nodes, edges, _ = (stored(name, df) for name, df in zip(("nodes", "edges", "calls"), graph.build_graph(classes, statements)))
        stored("incoming", edges)
        chunks = vector.method_chunks(classes, java, nodes, edges).unionByName(vector.sql_chunks(statements))
        stored("chunks", vector.embed(chunks, backend=backend))
        stored("files", java.unionByName(mappers))

    if folder is None:
        scratch = Scratch(spark, "index")
        build(lambda name, df: scratch.write(df, name))
    else:
        publish.publish(spark, folder, lambda version: build(lambda name, df: _laid_out(spark, version, name, df)))
    progress("done", n, n)
    return Index(**made, backend=backend)


def _laid_out(spark: SparkSession, version: str, name: str, df: DataFrame) -> DataFrame:
    """A stored table, in the order of the column that it is looked up by: readers then skip what lies outside."""
    by = LOOKED_UP_BY.get(name)
    save_table(df.repartitionByRange(by).sortWithinPartitions(by) if by else df, f"{version}/{name}")
    return spark.read.schema(df.schema).parquet(f"{version}/{name}")


def load_index(spark: SparkSession, folder: str, backend: Callable[[list[str]], np.ndarray] = vector.hashed_bag) -> Index:
    """The current version of an index that `build_index` has stored."""
    version = publish.current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no index in {folder}")
    read = {name: spark.read.parquet(f"{version}/{name}") for name in (*STORED, "files")}
    return Index(**read, backend=backend)


class IndexJob:
    """One run of an index build at a time, and its state: status (idle, running, done, error), stage, current, total,
    error, stats, elapsed_sec."""

    def __init__(self, build: Callable[[Callable[[str, int, int], None]], Index]):
        self.build, self.lock, self.index = build, threading.Lock(), None
        self.state: dict = {"status": "idle", "stage": None, "current": 0, "total": 1, "error": None, "stats": None, "elapsed_sec": None}

    def _set(self, **values) -> None:
        with self.lock:
            self.state.update(values)

    def start(self) -> threading.Thread:
        """Starts a run in a thread; RuntimeError if one is running."""
        with self.lock:
            if self.state["status"] == "running":
                raise RuntimeError("an index build is already running")
            self.state.update(status="running", stage="waiting", current=0, total=1, error=None, stats=None, elapsed_sec=None)
        thread = threading.Thread(target=self._run, daemon=True)
        thread.start()
        return thread

    def _run(self) -> None:
        began = time.monotonic()
        try:
            self.index = self.build(lambda stage, done, total: self._set(stage=stage, current=done, total=total))
            self._set(status="done", stats={r["metric"]: r["value"] for r in index_stats(self.index).collect()}, elapsed_sec=time.monotonic() - began)
        except Exception as e:  # noqa: BLE001  whatever went wrong is what the state reports
            self._set(status="error", error=str(e), elapsed_sec=time.monotonic() - began)

    def status(self) -> dict:
        with self.lock:
            return dict(self.state)


def index_stats(index: Index) -> DataFrame:
    """(metric, value): what the graph holds, and chunks, URLs, tables."""
    extra = index.chunks.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("chunks").alias("metric"), "value")
    tables = index.catalog.agg(F.countDistinct("table_name").cast("double").alias("value")).select(F.lit("catalog_tables").alias("metric"), "value")
    return graph.graph_stats(index.nodes, index.edges, index.calls).unionByName(extra).unionByName(tables)


def _code_rows(index: Index, candidates: DataFrame) -> DataFrame:
    """Nodes with code: id, node_type, names, place, tier, code. Files that cannot be read are left out."""
    kept = candidates.where(F.col("node_type").isin(*C.CODE_NODES))
    files = index.files.where("content IS NOT NULL").select(F.col("path").alias("file_path"), "content")
    return kept.join(files, "file_path").select("id", "node_type", "class_name", "method_name", "file_path", "start_line", "end_line", "tier", "content", line_slice("content", F.col("start_line"), F.col("end_line")).alias("code"))


def _packed(rows: DataFrame, summary: str, budget: int) -> tuple[str, list[dict], bool]:
    labelled = rows.withColumn("label", C.block_label(F.col("node_type"), F.col("class_name"), F.col("method_name")))
    labelled = labelled.withColumn("block", C.block(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("node_type"), F.col("label"), F.col("code"))).withColumn("question", F.lit(1))
    packed = C.pack(labelled, "question", ["tier", "file_path", "start_line"], F.length("block"), budget, F.lit(len(summary)), ("id", "label", "end_line", "code", "block"))
    kept = packed.where("kept").orderBy("tier", "file_path", "start_line")
    shown = kept.select("block").collect()  # bounded by the budget
    left_out = not packed.where("NOT kept").isEmpty()
    return C.context_text(summary, [r["block"] for r in shown]), [r.asDict() for r in C.references(kept).collect()], left_out


def ask_context(index: Index, question: str, k: int = 5, budget: int = C.BUDGET) -> Context:
    query = [float(x) for x in index.backend([vector.QUERY + question])[0]]
    hits = vector.search(index.chunks, query, k).select(F.col("node_id").alias("id"), F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "node_id")).alias("rank"))  # k rows
    candidates = index.nodes.join(C.candidate_tiers(index.edges, hits), "id")
    summary = C.chain_summary(candidates).first()["summary"]
    code = _code_rows(index, candidates)
    constants = C.constant_classes(code.where(F.col("tier") == C.HIT).select(F.col("code").alias("text")), index.classes).join(code.select("class_name"), "class_name", "left_anti")
    made = constants.select(F.concat(F.lit("ETC_REF::"), "class_name").alias("id"), F.lit("ETC_REF").alias("node_type"), "class_name", F.lit(None).cast("string").alias("method_name"), "file_path", "start_line", "end_line", F.lit(C.HIT).alias("tier"))
    made = made.join(index.files.select(F.col("path").alias("file_path"), "content"), "file_path").withColumn("code", line_slice("content", F.col("start_line"), F.col("end_line")))
    text, refs, left_out = _packed(code.unionByName(made), summary, budget)
    return Context(text, refs, summary, left_out)


def question_hits(index: Index, questions: DataFrame, k: int = 5) -> DataFrame:
    """q, id, rank: the k nearest chunks of each question. questions: q and vector, or text, which is embedded."""
    if "vector" not in questions.columns:
        questions = vector.embed(questions, "text", vector.QUERY, index.backend, "vector")
    chunks = index.chunks.select(F.col("node_id").alias("id"), F.col("embedding").alias("vector"))
    questions = Scratch(questions.sparkSession, "asked").write(questions.select("q", "vector"), "vectors")
    once = questions.groupBy("vector").agg(F.min("q").alias("query"))  # equal questions are one search
    found = vector_index.top_k_join(once.select("query", "vector"), chunks, k).select("query", "id", "rank")
    return questions.join(once, "vector").select("q", "query").join(found, "query").select("q", "id", "rank")


@dataclass
class _Packing:
    """What questions share. Those with equal hits are one group (g), for which everything is found and packed once.

    Rows of a group go as arrays of at most about `C.PIECE` ids: a node that reaches much, and that many questions hit,
    would make a row for each question and node in every step. A group whose summary leaves no room for the smallest block
    keeps none, so its blocks are neither sorted nor packed."""

    groups: DataFrame  # q, g
    sums: DataFrame  # g, used, and summary if asked for
    blocks: DataFrame  # at, id, place, label, size, digest, and code, block if asked for
    places: DataFrame  # the blocks without texts, and nth, their order in a tier
    packed: DataFrame  # g, tier, nth, id, at, size, kept, used of groups with room
    full: DataFrame  # g, used of groups without room
    sets: DataFrame  # g, sets of ids by tier, of groups without room
    covered: DataFrame  # g of groups without room that have blocks
    constants: DataFrame | None  # g, tier and the place of small classes that the code of hits names, of all groups
    single: bool  # no node has two blocks

    def left_out(self, *columns: str) -> DataFrame:
        """q, tier, id, used, and columns of the places, of the blocks of groups without room."""
        heads = self.groups.join(self.full, "g")
        rows = C.each_id(self.sets.join(heads, "g").select("q", "used", "sets"))
        if columns or not self.single:
            rows = rows.join(self.places.where("node_type <> 'ETC_REF'").select("id", *columns), "id")
        rows = rows.select("q", "tier", "id", "used", *columns)
        if self.constants is not None:
            rows = rows.unionByName(self.constants.join(heads, "g").select("q", "tier", "id", "used", *columns))
        return rows.withColumn("kept", F.lit(False))


def _packing(index: Index, hits: DataFrame, budget: int, texts: bool, longest: int | None = None) -> _Packing:
    """hits: q, id, rank. texts: with the summaries and the blocks themselves, not only their sizes; of blocks of more than
    `longest` characters only sizes."""
    scratch = Scratch(hits.sparkSession, "questions")
    hits = scratch.write(hits, "hits")
    groups = scratch.write(C.question_groups(hits), "groups")
    hits = hits.join(groups.where("q = g"), "q").select("g", "id", "rank")
    reached = scratch.write(C.around(index.edges, hits), "around")
    asked = scratch.write(C.asked_starts(hits, reached), "asked")
    nodes = index.nodes.join(reached.select("id").distinct(), "id", "left_semi")
    named = scratch.write(C.pieces(asked, reached, C.names(nodes, scratch), ("kind",)), "named")
    parts = scratch.write(C.summary_parts(asked, named, texts), "parts")
    sums = scratch.write(C.chain_summaries(groups.where("q = g").select("g"), parts), "sums")

    rows, names = _code_rows(index, nodes.withColumn("tier", F.lit(0))).drop("tier", "content"), None
    small = (F.col("layer") == "ETC") & (F.col("end_line") - F.col("start_line") + 1 <= C.CONSTANT_LINES)
    classes = index.classes.where(small).select("class_name", "file_path", "start_line", "end_line")
    if not classes.isEmpty():
        hit = rows.join(hits.select("id").distinct(), "id", "left_semi")
        names = hit.select("id", F.explode(F.regexp_extract_all("code", F.lit(C.CONSTANT), F.lit(1))).alias("class_name")).distinct()
        names = scratch.write(names.join(classes.select("class_name").distinct(), "class_name", "left_semi"), "names")
        as_node = {"id": F.concat(F.lit("ETC_REF::"), "class_name"), "node_type": F.lit("ETC_REF"), "method_name": F.lit(None).cast("string")}
        classes = classes.join(names.select("class_name").distinct(), "class_name", "left_semi").join(index.files.select(F.col("path").alias("file_path"), "content"), "file_path")
        rows = rows.unionByName(classes.withColumns(as_node).withColumn("code", line_slice("content", F.col("start_line"), F.col("end_line"))).drop("content"))
    rows = rows.withColumn("label", C.block_label(F.col("node_type"), F.col("class_name"), F.col("method_name")))
    block = C.block(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("node_type"), F.col("label"), F.col("code"))
    rows = rows.withColumn("block", block).withColumns({"size": F.length("block"), "digest": F.xxhash64("block"), "at": F.monotonically_increasing_id()})
    kept = ["id", "node_type", "class_name", "file_path", "start_line", "end_line", "label", "size", "digest", "at"]
    text = [c if longest is None else F.when(F.col("size") <= longest, F.col(c)).alias(c) for c in ("code", "block")] if texts else []
    blocks = scratch.write(rows.select(*kept, *text), "blocks")
    order = ["file_path", "start_line", "id", "label", "end_line", "digest", "at"]
    places = blocks.select(*kept).repartitionByRange(*order).sortWithinPartitions(*order)
    places = scratch.write(places.withColumn("nth", F.monotonically_increasing_id()), "places")

    plain = places.where("node_type <> 'ETC_REF'")
    least, n, ids = places.agg(F.min("size"), F.count_if(F.col("node_type") != "ETC_REF"), F.count_distinct(F.when(F.col("node_type") != "ETC_REF", F.col("id")))).first()
    chunk = F.pmod(F.xxhash64("id"), F.lit(-(-ids // C.PIECE) or 1))
    coded = scratch.write(C.pieces(asked, reached, plain.select("id").distinct().select("id", chunk.alias("chunk"), F.col("id").alias("value"))), "coded")
    room = F.col("used") + (least or 0) <= budget
    open_, full = sums.where(room).select("g", "used"), sums.where(~room).select("g", "used")
    constants = _constants(names, hits, asked, reached, places) if names is not None else None

    columns = ["g", "tier", "nth", "id", "at", "size"]
    rows = C.each_id(C.tiers_of(asked.join(open_, "g", "left_semi"), coded)).join(plain, "id").select(*columns)
    rows = rows if constants is None else rows.unionByName(constants.select(*columns))
    packed = C.pack(rows.join(open_, "g"), "g", ["tier", "nth"], F.col("size"), budget, F.col("used"), ("id", "at"))
    packed = scratch.write(packed, "packed")
    closed = asked.join(full, "g", "left_semi")
    covered = closed.join(coded.select("start", "tier", "wide").distinct(), ["start", "tier", "wide"], "left_semi").select("g")
    covered = covered if constants is None else covered.union(constants.select("g").join(full, "g", "left_semi"))
    return _Packing(groups, sums, blocks, places, packed, full, C.tiers_of(closed, coded), covered.distinct(), constants, n == ids)


def _constants(names: DataFrame, hits: DataFrame, asked: DataFrame, reached: DataFrame, places: DataFrame) -> DataFrame:
    """g, tier and the places of the classes that a group's hits name (names: id, class_name), but for those that have blocks
    among its candidates anyway."""
    own = places.where("node_type <> 'ETC_REF'").join(names.select("class_name").distinct(), "class_name", "left_semi")
    shown = asked.join(reached.join(own.select("id", "class_name"), "id"), ["start", "tier"]).select("g", "class_name")
    wanted = names.join(hits, "id").select("g", "class_name").distinct().join(shown, ["g", "class_name"], "left_anti")
    return wanted.join(places.where("node_type = 'ETC_REF'"), "class_name").withColumn("tier", F.lit(C.HIT))


def question_packs(index: Index, hits: DataFrame, budget: int = C.BUDGET) -> DataFrame:
    """q, id, tier, kept, used of the candidate blocks of all questions, as `question_blocks` packs them."""
    p = _packing(index, hits, budget, texts=False)
    rows = p.packed.join(p.groups, "g").select("q", "tier", "id", "used", "kept")
    return rows.unionByName(p.left_out()).select("q", "id", "tier", "kept", "used")


def question_blocks(index: Index, hits: DataFrame, budget: int = C.BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidate blocks of all questions, packed question by question (q, tier, file_path, start_line, id, label,
    end_line, digest, at, size, kept, used); the blocks themselves (at, code, block), once however many ask; and q, summary.
    hits: q, id, rank. Only sizes go with the questions: a node that many questions reach would repeat its text for each, and
    a summary names all of a question's nodes."""
    p = _packing(index, hits, budget, texts=True)
    place = ["file_path", "start_line", "label", "end_line", "digest", "at", "size"]
    rows = p.packed.drop("id", "size").join(p.places.select("id", *place), "at").join(p.groups, "g").select("q", "tier", "id", "used", *place, "kept")
    rows = rows.unionByName(p.left_out(*place))
    rows = rows.select("q", "tier", "file_path", "start_line", "id", "label", "end_line", "digest", "at", F.col("size").cast("long").alias("size"), "kept", "used")
    return rows, p.blocks.select("at", "code", "block"), p.groups.join(p.sums, "g").select("q", "summary")


def ask_contexts(index: Index, questions: DataFrame, k: int = 5, budget: int = C.BUDGET) -> DataFrame:
    """(q, summary, text, references, truncated): `ask_context` of any number of questions in one plan. questions: q
    (unique) and text, or vector. A row holds kept blocks only, so its size is bounded by the budget."""
    p = _packing(index, question_hits(index, questions, k), budget, texts=True, longest=budget)  # longer ones are not kept
    snippet = F.substring(F.regexp_replace("code", r"^\s+|\s+$", ""), 1, 200)
    reference = F.struct(F.col("file_path").alias("file"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), F.col("label").alias("class_method"), snippet.alias("snippet"))
    part = F.struct("file_path", "start_line", "id", "block", reference.alias("reference"))
    shown = p.blocks.where(F.col("size") <= budget).select("at", part.alias("part"))
    kept = p.packed.where("kept").select("g", "tier", "at").join(shown, "at")
    kept = kept.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("tier", "part"))), lambda x: x["part"]).alias("parts"))
    cut = p.packed.groupBy("g").agg(F.bool_or(~F.col("kept")).alias("truncated")).unionByName(p.covered.select("g", F.lit(True).alias("truncated")))
    none = F.array().cast(kept.schema["parts"].dataType)
    made = p.sums.select("g", "summary").join(cut, "g", "left").join(kept, "g", "left")
    whole = questions.select("q").join(p.groups, "q", "left").join(made, "g", "left").withColumn("parts", F.coalesce("parts", none))
    summary = F.coalesce("summary", F.lit(C.NOTHING))
    text = F.array_join(F.concat(F.array(summary), F.transform("parts", lambda p: p["block"])), C.SEPARATOR)
    return whole.select(
        "q",
        summary.alias("summary"),
        F.coalesce(text, summary).alias("text"),
        F.transform("parts", lambda p: p["reference"]).alias("references"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def diagnose_context(index: Index, log: str, own_prefix: str, budget: int = C.BUDGET) -> Context:
    """Status 400 if the log is no stack trace; without an own frame there is nothing to look up. The origin's block marks
    the failing line; if that lies outside the method (the code has moved), the first line is marked, with a warning."""
    spark = index.nodes.sparkSession
    trace = stacktrace.parse_traces(spark.createDataFrame([(log,)], "content string"), own_prefix=own_prefix).first()
    if not trace["is_trace"]:
        return Context("", status=400, warning="not a stack trace")
    origin = trace["origin_frame"]
    if origin is None:
        return Context("", warning="no frame of this system")
    node, warning = graph.node_by_symbol(index.nodes, origin["class_name"], origin["method_name"]).first(), None
    if node is None:
        query = [float(x) for x in index.backend([f"{vector.QUERY}{origin['class_name']} {origin['method_name']}"])[0]]
        near = vector.search(index.chunks, query, 1).first()
        node = index.nodes.where(F.col("id") == near["node_id"]).first() if near else None
        if node is None:
            return Context("", warning="unknown method")
        warning = "method not found, the nearest one is shown"
    line = origin["line_number"]
    if not node["start_line"] <= line <= node["end_line"]:
        warning, line = warning or f"line {line} is outside {node['label']}", node["start_line"]
    around, _ = graph.full_chain(index.nodes, index.edges, node["id"])
    summary = C.chain_summary(around).first()["summary"]
    code = _code_rows(index, around.withColumn("tier", F.when(F.col("id") == node["id"], C.HIT).otherwise(C.OTHER)))
    code = code.withColumn("code", F.when(F.col("id") == node["id"], marked_slice("content", F.col("start_line"), F.col("end_line"), F.lit(line))).otherwise(F.col("code")))
    text, refs, left_out = _packed(code, summary, budget)
    return Context(text, refs, summary, left_out, [r["label"] for r in C.call_chain(around).collect()], warning)


def manual(index: Index, describe: Callable[[dict], str], domains: list[str] | None = None, only: str | None = None, titles: dict[str, str] | None = None, cached: DataFrame | None = None) -> str:
    """A section a domain, an entry a URL with its title, procedure and chain. `describe` writes a procedure from the
    entry's facts, unless all its implementations only delegate or `cached` (url, procedure, generated_at) has one."""
    rows = C.manual_rows(index.nodes, index.edges, titles).withColumn("domain", first_url_segment("url"))
    code = _code_rows(index, index.nodes.withColumn("tier", F.lit(C.OTHER))).where("node_type = 'IMPL_METHOD'").withColumn("label", F.concat_ws(".", "class_name", "method_name"))
    trivial = C.is_trivial(rows.select("url", F.explode_outer("impls").alias("label")).join(code, "label"), "url")
    known = rows.join(trivial, "url", "left")
    known = with_cached(known, cached) if cached is not None else known.withColumn("procedure", F.lit(None).cast("string"))
    facts = [r.asDict() for r in known.orderBy("url").collect()]  # a row a URL
    entries = [f | {"body": f["procedure"] or ("Delegates to the service." if f["trivial"] else describe(f))} for f in facts]
    named = domains or sorted({f["domain"] for f in facts})
    return C.assemble_manual(entries, named, only, [r["markdown"] for r in C.appendix(index.catalog).orderBy("table_name").collect()])


def list_page(tables: Tables, rows: Callable[..., DataFrame], count: Callable[..., DataFrame], page_index: int | None = None, page_size: int | None = None, **given) -> tuple[DataFrame, DataFrame]:
    """A page of a list and its pagination row, from one of the relational lists and its count."""
    total = count(tables, **given)
    row = total.select(F.col("cnt").alias("total"), *(c.alias(n) for n, c in pagination("cnt", page_index, page_size).items()))
    first = row.select("first_index", "page_size").first()
    return rows(tables, **given, offset=first["first_index"], count=first["page_size"]), row
