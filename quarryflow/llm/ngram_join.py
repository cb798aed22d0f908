"""Operator 10: n-gram Jaccard join by parity sketches.

A document's set holds its distinct n-word shingles. Documents whose sets are equal become one class; only classes are
compared. A class of n shingles has a parity sketch: every shingle flips one of k bits, and k grows with the size band.
Two sketches differ in at most as many bits as the sets have shingles apart, so a Hamming distance above the largest
symmetric difference that the threshold allows rules a pair out without a miss.

Candidates come from a pigeonhole join in each size band. There the sketch is read as SEGMENTS words of 64 bits, into
which the shingles' hashes are XORed: one to two shingles a word on average, so a word says which of them are odd. A pair
within the threshold is apart in at most D = floor(n / 3) shingles (at 75 %), so at most D words differ and all others are
equal. Of the words that are not empty, it is enough to index the D + 1 that come first in a common order, rarest first: by
pigeonhole the first equal word is among them on both sides, if either side has more than D of them. A class with fewer
is dealt into words again by the next of a series of hashes, until it has enough. Two classes meet under the hash with
which the first of them has enough, since the other one is indexed under it too; so no key is shared by default. Classes
of the upper quarter of a band are indexed in the next band too, so sizes on both sides of a band's border meet.

Within a key all members are first compared with the least one only. Where that leaves a key's members in more than one
component, the other pairs across components are compared as well, in blocks, sketches first: at first only as many pairs
as would join the components, then, for keys where one of those was no link, all across the components still apart. Every candidate that the sketches
do not rule out is verified on the shingle sets. So no link between different sets is lost, and the pairs of a
group of near copies are never listed.

Defined results: null texts and texts without words have an empty set and are linked with nothing; texts of fewer than n
words have one shingle, their whole sequence; rows with equal sets are linked, whatever their ids; a null id is never a
component's least id unless all are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, hinted, tidied
from .components import components
from .hashing import Words, as_bytes, mix, signed

COUNT_BITS = 16
#: Members of a key that are compared with one another at once.
GROUP_BLOCK = 2048


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; linked at a Jaccard similarity of num / den or more."""

    words: int = 5
    num: int = 75
    den: int = 100

    def apart(self, total: int | np.ndarray) -> int | np.ndarray:
        """Largest symmetric difference of linked sets whose sizes sum to total."""
        return total * (self.den - self.num) // (self.den + self.num)

    def most_apart(self, n: int) -> int:
        """The same for a set of n and any partner."""
        return int(self.apart(n + n * self.den // self.num))


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z."""
    w = Words(texts, lower=True)
    n, at = w.count, w.first
    starts = np.repeat(at, np.maximum(n - words + 1, n > 0)) + _ramp(np.maximum(n - words + 1, n > 0))
    size = np.minimum(words, np.repeat(n, np.maximum(n - words + 1, n > 0)))
    h = w.run(starts, starts + size)
    cut = np.cumsum(np.maximum(n - words + 1, n > 0))
    return [np.unique(x) for x in np.split(h, cut[:-1])] if len(cut) else []


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 ... c - 1 for each count c in turn."""
    counts = counts.astype(np.int64)
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def band_of(n: int) -> int:
    return int(n).bit_length()


def segments(band: int) -> int:
    """Words of the sketch that is joined: half the largest size of the band."""
    return 1 << band - 1


def sketch_bits(band: int) -> int:
    """Bits of a stored sketch, a folded form: two to four times the size of the set, so few flips fall together and the
    distance stays close to the number of shingles apart."""
    return max(8, 2 << band)


def sketch(shingles: np.ndarray, band: int) -> bytes:
    """Parity bits."""
    k = sketch_bits(band)
    flips = np.bincount((shingles & np.uint64(k - 1)).astype(np.int64), minlength=k) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def fold(bits: bytes, band: int) -> bytes:
    """A sketch of the same set for a smaller band; the position is the low bits, so halves are XORed."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) * 8 > sketch_bits(band):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def keys(shingles: np.ndarray, rarity: np.ndarray, rule: Rule) -> np.ndarray:
    """Pigeonhole keys of a set in the bands where it meets its partners."""
    n = len(shingles)
    far = rule.most_apart(n)
    if not far:
        return np.zeros(0, np.uint64)  # only an equal set can be linked
    out = []
    level = rarity[(shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64)
    for band in range(band_of(n), band_of(n * rule.den // rule.num) + 1):
        deal, content = 0, ()
        while len(content) <= far:
            place = (shingles if not deal else mix(shingles, 200 + deal)) & np.uint64(segments(band) - 1)
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(place[order]) != 0))
            content = np.bitwise_xor.reduceat(shingles[order], cuts)
            rank = np.minimum.reduceat(level[order], cuts) << np.uint64(58) | mix(content) >> np.uint64(6)
            first = content[np.argpartition(rank, far)[: far + 1]] if len(content) > far + 1 else content
            out.append(mix(first, 100 + band + 64 * deal))
            deal += 1
    return np.concatenate(out)


_SETS = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.binary()), ("bucket", pa.int32()), ("seen", pa.int64())])


def _sets(rule: Rule):
    """A row a text (rid, id, th, n, set key, sketch), and at a task's end a row for each bucket of shingle hashes that it has counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid, counts = TaskContext.get().partitionId() << 36, np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column("text")), rule.words)
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            counts += np.bincount((flat >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
            owner = np.repeat(np.arange(len(sets)), n)
            sums = [np.zeros(len(sets), np.uint64) for _ in range(2)]
            for k, s in enumerate(sums):
                np.add.at(s, owner, mix(flat, 11 + k))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(sets))), batch.column("id"), batch.column("th"), pa.array(n), pa.array(signed(sums[0])), pa.array(signed(sums[1])), pa.array([sketch(s, band_of(len(s))) for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int64())], schema=_SETS)
            rid += len(sets)
        full = np.flatnonzero(counts)
        empty = [pa.nulls(len(full), t) for t in _SETS.types[:-2]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(full.astype(np.int32)), pa.array(counts[full])], schema=_SETS)

    return run


def _key_rows(rule: Rule, rarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(rarity.value, np.uint8)
        for batch in batches:
            found = [keys(s, table, rule) for s in shingle_sets(as_bytes(batch.column("text")), rule.words)]
            n = np.array([len(x) for x in found], np.int64)
            rid = np.repeat(batch.column("rid").to_numpy(zero_copy_only=False), n)
            flat = signed(np.concatenate(found)) if len(found) else np.zeros(0, np.int64)
            for i in range(0, len(flat), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(flat[i : i + (1 << 18)]), pa.array(rid[i : i + (1 << 18)])], names=["key", "rid"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and rid: (key, least rid of the key, rid) of every member but the least. Constant memory."""
    key0 = least0 = last0 = None
    for batch in batches:
        key, rid = (batch.column(i).to_numpy() for i in range(2))
        if not len(key):
            continue
        new = np.append(True, key[1:] != key[:-1])
        new[0] = key0 is None or key[0] != key0
        start = np.flatnonzero(new)
        least = np.empty_like(rid)
        head = start[0] if len(start) else len(rid)
        least[:head] = least0 if head else 0
        if len(start):
            least[head:] = np.repeat(rid[start], np.diff(np.append(start, len(rid))))
        again = ~new & (rid == np.concatenate(([rid[0] - 1 if last0 is None else last0], rid[:-1])))
        keep = ~new & (rid != least) & ~again
        key0, least0, last0 = key[-1], least[-1], rid[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(least[keep]), pa.array(rid[keep])], names=["key", "least", "rid"])


def _within(rule: Rule, a_bits: bytes, b_bits: bytes, a_n: int, b_n: int) -> bool:
    if min(a_n, b_n) * rule.den < max(a_n, b_n) * rule.num:
        return False
    band = min(band_of(a_n), band_of(b_n))
    x, y = np.frombuffer(fold(a_bits, band), np.uint8), np.frombuffer(fold(b_bits, band), np.uint8)
    return int(np.bitwise_count(x ^ y).sum()) <= rule.apart(a_n + b_n)


def _sketched(rule: Rule):
    """Candidate pairs that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            ok = [_within(rule, *x) for x in zip(c["sa"], c["sb"], c["na"], c["nb"])]
            yield pa.RecordBatch.from_pydict({n: [v for v, o in zip(c[n], ok) if o] for n in ("a", "b")}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _cross(rule: Rule, forest: bool):
    """From members sorted by key, pair of blocks: pairs of one key in different components that sketches do not rule out.
    forest: only those that join components which the pairs before have not joined."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        out, up = [], {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        rows.sort(key=lambda r: r[2])
        n, comp, rid, block = (np.array([r[i] for r in rows]) for i in (2, 1, 0, 4))
        bits = {}
        for band in {band_of(int(x)) for x in n}:
            bits[band] = np.stack([np.frombuffer(fold(r[3], band), np.uint8) if band_of(r[2]) >= band else np.zeros(sketch_bits(band) // 8, np.uint8) for r in rows])
        mixed = len(set(block.tolist())) > 1
        for i in range(len(rows)):
            j = np.arange(i + 1, int(np.searchsorted(n, n[i] * rule.den // rule.num, side="right")))
            j = j[comp[j] != comp[i]]
            if mixed:
                j = j[block[j] != block[i]]
            if len(j):
                own = bits[band_of(int(n[i]))]
                near = np.bitwise_count(own[j] ^ own[i]).sum(axis=1) <= rule.apart(n[i] + n[j])
                if not forest:
                    out += [(int(rid[i]), int(x)) for x in rid[j[near]]]
                    continue
                for c, x in zip(comp[j[near]].tolist(), rid[j[near]].tolist()):
                    if (a := root(int(comp[i]))) != (b := root(c)):
                        up[b] = a
                        out.append((int(rid[i]), x))
        return out

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [p[i] for p in found] for i, n in enumerate(("key", "a", "b"))}, schema=pa.schema([(n, pa.int64()) for n in ("key", "a", "b")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            found = []
            c = batch.to_pydict()
            for key, lo, hi, *row in zip(*(c[n] for n in ("key", "lo", "hi", "rid", "comp", "n", "sketch", "block"))):
                if (key, lo, hi) != group:
                    if len(rows) > 1:
                        found += [(group[0], *p) for p in pairs(rows)]
                    group, rows = (key, lo, hi), []
                rows.append(tuple(row))
            yield made(found)
        yield made([(group[0], *p) for p in pairs(rows)] if len(rows) > 1 else [])

    return run


def _set_rows(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column("text")), rule.words)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "members"])

    return run


def _verified(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, ok = batch.to_pydict(), []
            for x, y in zip(c["ma"], c["mb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(rule.den * both >= rule.num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({n: [v for v, o in zip(c[n], ok) if o] for n in ("a", "b")}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def jaccard_components(df: DataFrame, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id reachable by links) of every row. The id must be an integer."""
    kind = df.schema[id_col].dataType
    rows = similar_groups(df, rule, id_col, text_col)
    return rows.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id"))


def similar_groups(df: DataFrame, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (a 64-bit hash of the text), n (shingles), root (a number of the component, null for an empty set), component
    (its least id) of every row. The id must be an integer."""
    rule = rule or Rule()
    spark = df.sparkSession
    arrow_limits(spark)  # arrays over a batch take some forty times its text
    scratch = Scratch(spark, "ngram")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    made = scratch.write(texts.mapInArrow(tidied(_sets(rule)), "rid long, id long, th long, n long, k1 long, k2 long, sketch binary, bucket int, seen long"), "sets")
    sets = made.where(F.col("rid").isNotNull())
    seen = made.where(F.col("rid").isNull()).groupBy("bucket").agg(F.sum("seen").alias("seen")).collect()  # 65,536 rows at most
    rarity = np.zeros(1 << COUNT_BITS, np.uint8)
    for r in seen:
        rarity[r["bucket"]] = min(63, int(4 * np.log2(1 + r["seen"])) // 2)
    table = spark.sparkContext.broadcast(rarity.tobytes())

    # One row stands for each class of equal sets.
    classes = scratch.write(sets.where(F.col("n") > 0).groupBy("k1", "k2", "n").agg(F.min("rid").alias("rid"), F.min("id").alias("least_id")), "classes")
    heads = sets.join(classes.select("rid"), "rid", "left_semi")
    heads = scratch.write(heads.where(F.col("n") > 2).select("rid", "id", "th", "n", "sketch"), "heads")
    texts_of = lambda chosen: texts.join(hinted(chosen.select("rid", F.col("id").alias("hid"), F.col("th").alias("hth")), 40), F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth"))).select("rid", "text")

    rows = texts_of(heads).mapInArrow(tidied(_key_rows(rule, table)), "key long, rid long")
    members = scratch.write(rows.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(tidied(_shared), "key long, least long, rid long"), "members")

    linked = _links(members.select(F.col("least").alias("a"), F.col("rid").alias("b")).distinct(), heads, texts_of, rule, scratch, "star", True)
    labels = components(linked, scratch)
    for step in ("forest", "all"):
        found = _across(members, labels, heads, rule, scratch, step)
        if found.isEmpty():
            break
        more = _links(found.select("a", "b").distinct(), heads, texts_of, rule, scratch, step, False)
        linked = linked.union(more)
        labels = components(linked, Scratch(spark, "ngram"))
        # Where every pair of a key's forest is linked, no candidate of that key is left across components.
        failed = scratch.write(found.join(more, ["a", "b"], "left_anti").select("key").distinct(), f"{step}-failed")
        members = members.join(hinted(failed, 16), "key", "left_semi")
    root = classes.join(labels, classes["rid"] == labels["node"], "left").select("k1", "k2", "n", "least_id", F.coalesce("root", "rid").alias("root"))
    root = scratch.write(root, "roots")
    least = root.groupBy("root").agg(F.min("least_id").alias("component"))
    named = scratch.write(root.join(least, "root").select("k1", "k2", "n", "root", "component"), "named")
    same = [sets[c] == named[c] for c in ("k1", "k2", "n")]
    return sets.join(named, same, "left").select("id", "th", sets["n"], "root", "component")


def _links(pairs: DataFrame, heads: DataFrame, texts_of, rule: Rule, scratch: Scratch, name: str, sketches: bool) -> DataFrame:
    """The pairs (a, b) that are linked, by sketches and then by their sets."""
    if sketches:
        s = heads.select("rid", "n", "sketch")
        pairs = pairs.join(s.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        pairs = pairs.where(F.least("na", "nb") * rule.den >= F.greatest("na", "nb") * rule.num).mapInArrow(tidied(_sketched(rule)), "a long, b long")
    pairs = scratch.write(pairs, f"{name}-pairs")
    wanted = scratch.write(pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct(), f"{name}-wanted")
    chosen = scratch.write(heads.select("rid", "id", "th").join(hinted(wanted, 16), "rid", "left_semi"), f"{name}-chosen")
    sets = scratch.write(texts_of(chosen).mapInArrow(tidied(_set_rows(rule)), "rid long, members binary").dropDuplicates(["rid"]), f"{name}-sets")
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("rid").alias("b"), F.col("members").alias("mb")), "b")
    return scratch.write(both.select("a", "b", "ma", "mb").mapInArrow(tidied(_verified(rule)), "a long, b long"), f"{name}-links")


def _across(members: DataFrame, labels: DataFrame, heads: DataFrame, rule: Rule, scratch: Scratch, step: str) -> DataFrame:
    """(key, a, b): pairs of one key in different components, as far as their sketches allow a link; a key's least member has
    been compared with all others before. Large groups are cut into blocks, and every two blocks of a key meet in a task
    of their own."""
    placed = members.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("comp"))
    placed = scratch.write(placed, f"{step}-placed")
    groups = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    groups = scratch.write(groups.select("key", F.ceil(F.col("size") / GROUP_BLOCK).cast("int").alias("blocks")), f"{step}-groups")
    open_ = placed.join(hinted(groups, 24), "key").join(heads.select("rid", "n", "sketch"), "rid")
    block = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rid", "comp", "n", "sketch", "block")
    found = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(tidied(_cross(rule, step == "forest")), "key long, a long, b long")
    return scratch.write(found.distinct(), f"{step}-across")
