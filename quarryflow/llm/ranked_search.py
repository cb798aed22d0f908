"""Operator 13: ranked lexical search by TPUT (three phases, one uniform threshold) over term-partitioned postings.

Postings are (term, doc, impact), dealt and sorted by term and falling impact: a list's head is its first rows, and a
common term's list may span many files. A document's score for an item is the sum over the item's terms of weight times
impact, in whole numbers.

1. The heads of the lists name candidates, and the k-th best exact score among an item's candidates is a lower bound of
   its k-th best score at all, tau.
2. With m lists, every list is read down to the threshold tau / (2 m). What a document got from the lists so far, plus
   the threshold for each list that it was not read from, bounds its score; documents whose bound is below tau are out,
   as are those that no list named: they score less than tau / 2.
3. The remaining documents' exact scores are looked up in the lists. The best k of each item are the result.

Only postings of terms that some item asks for are made. They are dealt by document before items are joined to them, so
what one term gives to many items is added up where it is made and is never shuffled.

Defined results: null and empty texts have no terms, and such documents are in no list; an item without terms, or whose
terms no document holds, has no rows; rows that repeat a doc_id are documents of their own, and rows that repeat an
item_id are items of their own; among equal scores the least doc_id comes first, null last; a term that nearly every
document holds may weigh nothing; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, hinted, tidied

#: Rows of a list's head.
HEAD = 50
#: Asked terms up to so many bytes are sent to the workers; beyond that all postings are made and joined with them.
ASKED_BYTES = 16 << 20

#: Byte by byte: ASCII letters in lower case, digits and whatever is not ASCII stay, all else separates terms.
_AS_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def as_terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats."""
    return text.translate(_AS_TERM).split()


def _terms(df: DataFrame, id_col: str, text_col: str, asked: frozenset[bytes] | None = None) -> DataFrame:
    """(row, id, n, terms, tfs): n counts all terms of a text with repeats, the lists hold the asked ones once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, terms, tfs = [], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                found = as_terms(text or b"")
                count = Counter(found if asked is None else [t for t in found if t in asked])
                counts.append(len(found))
                terms.append(list(count))
                tfs.append(list(count.values()))
            lists = [pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))]
            columns = [batch.column("row"), batch.column("id"), pa.array(counts, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n", "terms", "tfs"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), f"row long, id {dict(rows.dtypes)['id']}, n long, terms array<string>, tfs array<long>")


def _each(rows: DataFrame, *keep: str) -> DataFrame:
    pairs = rows.select(*keep, F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return pairs.select(*keep, F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def impact(tf: Column, n: Column, documents: int, length: int) -> Column:
    """(10 ** 9 * tf) div (1000 * tf + 8 * m) with m = 25 + (75 * n * N) div L, of which a product may exceed a long."""
    product = n.cast("decimal(19,0)") * F.lit(75 * documents).cast("decimal(19,0)")
    m = _div(product, F.lit(length).cast("decimal(38,0)")) + 25
    return _div(tf * F.lit(1_000_000_000).cast("long"), tf * 1000 + m * 8)


def weight(df: Column, documents: int) -> Column:
    return F.floor(F.log((F.lit(2.0 * documents) + 2) / (df * 2.0 + 1)) * 1000).cast("long")


def _postings(docs: Callable[[frozenset[bytes] | None], DataFrame], asked: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(term, doc, id, impact) of the asked terms by term and falling impact, and the number of documents with a term."""
    size = asked.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    few = frozenset(r["term"].encode() for r in asked.collect()) if size <= ASKED_BYTES else None
    counted = scratch.write(docs(few), "docs")
    documents, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = _each(counted, "row", "id", "n")
    if few is None:
        each = each.join(hinted(asked, F.octet_length("term") + 64), "term", "left_semi")
    value = impact(F.col("tf"), F.col("n"), documents, max(length, 1)).alias("impact")
    found = each.select("term", F.col("row").alias("doc"), "id", value)
    order = ("term", F.desc("impact"), "doc")
    return scratch.write(found.repartitionByRange(*order).sortWithinPartitions(*order), "postings"), documents


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _exact(candidates: DataFrame, postings: DataFrame, lists: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(item, doc, id, score) of candidates (item, doc): their entries in the item's lists, looked up."""
    wanted = hinted(candidates, 48)
    entries = postings.join(wanted, "doc").join(hinted(lists.select("item", "term", "g"), 96), ["item", "term"])
    return scratch.write(entries.groupBy("item", "doc", "id").agg(F.sum(F.col("g") * F.col("impact")).alias("score")), name)


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
    head: int = HEAD,
) -> DataFrame:
    """(item, rank, doc, score): the k documents of highest score above 0 for each item."""
    arrow_limits(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "search")
    asked = _each(scratch.write(_terms(items, item_col, item_text_col), "items"), "row", "id")
    terms = scratch.write(asked.select("term").distinct(), "terms")
    postings, documents = _postings(lambda few: _terms(docs, id_col, text_col, few), terms, scratch)

    held = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    gain = F.col("tf") * weight(F.col("df"), documents)
    lists = asked.join(held, "term").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term", gain.alias("g"))
    lists = lists.where("g > 0").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("item")))
    lists = scratch.write(lists, "lists")

    # Phase 1: candidates of the heads, and a lower bound of each item's k-th score.
    by_impact = Window.partitionBy("term").orderBy(F.desc("impact"), "doc")
    heads = postings.withColumn("place", F.row_number().over(by_impact)).where(F.col("place") <= max(head, k)).select("term", "doc")
    first = scratch.write(heads.join(hinted(lists.select("item", "term"), 64), "term").select("item", "doc").distinct(), "first")
    lower = _best(_exact(first, postings, lists, scratch, "lower"), k).groupBy("item")
    lower = lower.agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0).alias("tau"))

    # Phase 2: every list down to its item's threshold, by documents.
    reach = F.col("g") * F.col("m") * 2
    limits = lists.join(lower, "item").select("item", "term", "g", "m", "tau", _div(F.col("tau") + reach - 1, reach).alias("cut"))
    limits = scratch.write(limits, "limits")
    deepest = limits.groupBy("term").agg(F.min("cut").alias("deepest"))
    deepest = hinted(scratch.write(deepest, "deepest"), 64)
    read = postings.join(deepest, "term").where("impact >= deepest").select("term", "doc", "impact").repartition("doc")
    met = read.join(hinted(limits, 120), "term").where("impact >= cut").groupBy("doc", "item", "m", "tau")
    sums = met.agg(F.sum(F.col("g") * F.col("impact")).alias("partial"), F.count(F.lit(1)).alias("seen"))
    unseen = (F.col("m") - F.col("seen")) * _div(F.col("tau"), F.col("m") * 2)
    candidates = scratch.write(sums.where(F.col("partial") + unseen >= F.col("tau")).select("item", "doc"), "candidates")

    # Phase 3: their exact scores.
    best = _best(_exact(candidates, postings, lists, scratch, "scores").where("score > 0"), k)
    names = hinted(scratch.write(lists.select("item", "item_id").distinct(), "names"), 48)
    return best.join(names, "item").select(F.col("item_id").alias(item_col), F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
