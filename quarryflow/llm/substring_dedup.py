"""Operator 8: substring dedup by Relative Lempel-Ziv parsing against an index of all reference blocks.

The reference is the corpus itself. Every document is cut into blocks whose borders depend on content only: a run of
windows of `window` words whose least gram of `gram` words, their anchor, is the same. The index holds each block's
anchor, the 128-bit hash of its words and its number; blocks that follow one another in a document have following numbers.

A document is parsed greedily from its left end. A block that stands whole elsewhere opens a factor at that reference
block; the factor grows as long as the document's next block equals the reference's next one, and the parse goes on
behind it. Each block has at least `window` words, so every factor is long enough to be a duplicate span. Between factors,
where blocks share an anchor but not all words, the windows are compared one by one by their own hashes: two windows of
equal words have the same anchor at the same offset, so they lie in blocks of the same anchor. So exactly the windows
whose words start anywhere else are found.

What is counted grows with the number of blocks, about two for each `window - gram + 2` words, not with pairs: a passage
in a million documents adds a row for each, and no list of them is ever gathered. A block's reference is the first place
that holds it (the last one for that first place itself), so a passage's blocks point to consecutive places.

Defined results: null texts have no words; texts of fewer than `window` words lose nothing; rows with the same id and
text are one document that repeats, so both lose their windows; removal is judged on the input; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, hinted, tidied
from .hashing import Words, as_bytes, mix, signed

WINDOW, GRAM = 35, 8
_BLOCKS = pa.schema([("occ", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("s1", pa.int32()), ("s2", pa.int32()), ("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])


def least_positions(x: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, where its least one stands by its upper half, the first of equals. The lower half
    is the position, so the answer depends on the run alone."""
    bits = 32
    key = (x >> np.uint64(bits)) << np.uint64(bits) | np.arange(len(x), dtype=np.uint64)
    span, low = 1, key
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & np.uint64((1 << bits) - 1)).astype(np.int64)


def blocks(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window (as word positions of the batch) and anchor position of each block."""
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    at = np.arange(n - gram + 1)
    anchor = least_positions(mix(w.run(at, at + gram), 3), window - gram + 1)
    start = np.flatnonzero(w.of[: n - window + 1] == w.of[window - 1 :])
    if not len(start):
        return none, none, none
    anchor = anchor[start]
    cut = np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (w.of[start[1:]] != w.of[start[:-1]]))
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last], anchor[first]


def _index(window: int, gram: int):
    """A row for each block of each document. Numbers skip one between documents, so no factor runs across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        occ = TaskContext.get().partitionId() << 36
        for batch in batches:
            w = Words(as_bytes(batch.column("text")))
            s1, s2, at = blocks(w, window, gram)
            of = w.of[s1] if len(s1) else s1
            salt = (at - s1).astype(np.uint64) << np.uint64(32) | (s2 - s1).astype(np.uint64)
            content = [mix(w.run(s1, s2 + window, k) ^ mix(salt, 20 + k), 30 + k) for k in range(2)]
            take = pa.array(of)
            number = occ + np.arange(len(s1)) + of
            columns = [pa.array(number), batch.column("id").take(take), batch.column("th").take(take), pa.array((s1 - w.first[of]).astype(np.int32)), pa.array((s2 - w.first[of]).astype(np.int32)), pa.array(signed(w.run(at, at + gram))), *(pa.array(signed(c)) for c in content)]
            occ += len(s1) + batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, schema=_BLOCKS)

    return run


def _windows(window: int):
    """A row for each window of the listed blocks of a document: its 128-bit hash and where it starts."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("single", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, lists = Words(as_bytes(batch.column("text"))), batch.column("parts").to_pylist()
            packed = np.array([p for parts in lists for p in parts], np.int64)
            if not len(packed):
                continue
            k, s1, s2, single = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), packed >> 33, packed >> 1 & 0x7FFFFFFF, (packed & 1) > 0
            n = s2 - s1 + 1
            s = np.repeat(s1, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(k, n)
            at, take = s + w.first[of], pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(signed(w.run(at, at + window, 0))), pa.array(signed(w.run(at, at + window, 1))), batch.column("id").take(take), batch.column("th").take(take), pa.array(s.astype(np.int32)), pa.array(np.repeat(single, n))], schema=schema)

    return run


def parse(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy factors (first window, last window, reference block or -1) of a document. blocks: the same for each of its
    blocks that the index holds elsewhere, and single windows from the factor boundaries with -1."""
    factors: list[tuple[int, int, int]] = []
    follows = -1  # the reference block that would extend the last factor
    for s1, s2, ref in sorted(blocks):
        if factors and s1 == factors[-1][1] + 1 and (ref == follows if ref >= 0 else factors[-1][2] < 0):
            factors[-1] = (factors[-1][0], s2, factors[-1][2])
        else:
            factors.append((s1, s2, ref))
        follows = ref + 1 if ref >= 0 else -1
    return factors


def removed_words(n: int, factors: list[tuple[int, int, int]], window: int) -> np.ndarray:
    """Which words the windows of the factors cover."""
    gone = np.zeros(n, bool)
    for s1, s2, _ in factors:
        gone[s1 : s2 + window] = True
    return gone


def _block_lists(column: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
    """The blocks (first window, last window, reference) of each document; none for null."""
    offsets, values = column.offsets.to_numpy(), column.values
    place, ref = values.field("place").to_numpy(), values.field("ref").to_numpy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        at = place[a:b]
        yield list(zip((at >> 32).tolist(), (at & 0xFFFFFFFF).tolist(), ref[a:b].tolist()))


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(as_bytes(batch.column("text")), _block_lists(batch.column("blocks"))):
                words = (text or b"").split()
                gone = removed_words(len(words), parse(found), window)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)
                out.append((len(words), int(gone.sum()), kept.decode() if with_text else hashlib.sha256(kept).hexdigest()))
            n, removed, last = (list(x) for x in zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(last, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def _packed(high: int, low: int) -> Column:
    return F.shiftleft(F.col("s1").cast("long"), high).bitwiseOR(F.shiftleft(F.col("s2").cast("long"), low))


def _blocks_of_documents(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("id", "th").agg(F.collect_set(F.struct(_packed(32, 0).alias("place"), "ref")).alias("blocks"))


def duplicate_blocks(texts: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(id, th, s1, s2, ref): blocks that stand elsewhere, with the number of that reference block, and single windows
    that do, with -1; and the index (occ, id, th, s1, ...). texts: id long, th long (a hash of the text), text."""
    keys = ("anchor", "c1", "c2")
    index = scratch.write(texts.mapInArrow(tidied(_index(window, gram)), "occ long, id long, th long, s1 int, s2 int, anchor long, c1 long, c2 long"), "index")
    # Written first, so that the join reads both sides from exchanges of its own and can split a very common anchor.
    again = scratch.write(index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "again")
    shared = scratch.write(index.join(again, "anchor"), "shared")
    contents = scratch.write(shared.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("occ").alias("occ"), F.max("occ").alias("last")), "contents")
    whole = contents.where("n > 1").select(*keys, F.col("occ").alias("first"), "last")
    blocks = shared.join(whole, list(keys)).select("id", "th", "s1", "s2", F.when(F.col("occ") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("ref"))
    # Blocks that share an anchor but not all words: every window of one block for each content.
    differ = scratch.write(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("anchor"), "differ")
    edge = contents.join(differ, "anchor").select("occ", (F.col("n") == 1).alias("single"))
    parts = shared.join(edge, "occ").groupBy("id", "th").agg(F.collect_set(_packed(33, 1).bitwiseOR(F.col("single").cast("long"))).alias("parts"))
    parts = scratch.write(parts, "parts")
    with_text = texts.join(hinted(parts.withColumnsRenamed({"id": "pid", "th": "pth"}), 64 + 8 * F.size("parts")), F.col("id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth"))).select("id", "th", "text", "parts")
    windows = scratch.write(with_text.mapInArrow(tidied(_windows(window)), "w1 long, w2 long, id long, th long, s int, single boolean").distinct(), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k"), F.max("single").alias("any")).where("k > 1 AND any").select("w1", "w2")
    found = windows.where("single").join(twice, ["w1", "w2"]).select("id", "th", F.col("s").alias("s1"), F.col("s").alias("s2"), F.lit(-1).cast("long").alias("ref"))
    return blocks.unionByName(found), index


def relative_factors(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The parse itself, a row a factor: id, start (word), n_words, reference_id and reference_start, both null where a
    factor consists of windows that were found at a boundary. The id must be an integer."""
    spark = df.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "factors")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    blocks, index = duplicate_blocks(texts, scratch, window)
    by_doc = _blocks_of_documents(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            found = [(i, s1, s2 - s1 + window, ref) for i, b in zip(ids, _block_lists(batch.column("blocks"))) for s1, s2, ref in parse(b)]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["id", "start", "n_words", "ref"])

    factors = scratch.write(by_doc.select("id", "blocks").mapInArrow(tidied(run), "id long, start int, n_words int, ref long"), "factors")
    places = index.select(F.col("occ").alias("ref"), F.col("id").alias("reference_id"), F.col("s1").alias("reference_start"))
    return factors.join(places, "ref", "left").select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "start", "n_words", "reference_id", "reference_start")


def dedup_substrings(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id, n_words, n_removed and the kept words joined by one space: as `text`, or as `kept_sha256` without with_text.
    The id must be an integer."""
    spark = df.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "substring")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    blocks, _ = duplicate_blocks(texts, scratch, window)
    by_doc = scratch.write(_blocks_of_documents(blocks), "blocks")
    joined = texts.join(by_doc.withColumnsRenamed({"id": "fid", "th": "fth"}), F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left")
    out = joined.select("id", "text", "blocks").mapInArrow(tidied(_cut(window, with_text)), "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", F.col("kept").alias("text" if with_text else "kept_sha256"))
