"""Operator 6: embedding near-dedup by an epsilon grid order join.

Cosine c between unit vectors is Euclidean distance sqrt(2 - 2c), so the join looks for distances of at most epsilon.
Vectors are rotated to their principal directions, computed from the moments of all vectors, and sorted by the cells of
a grid of width epsilon on the leading ones. The sorted sequence is cut into intervals; each keeps the box of its
vectors in the leading directions, in which distances never exceed the true ones. Pairs of intervals are found by
descending a tree of boxes from its root: two nodes whose boxes are farther apart than epsilon are dropped with all that
is below them. Inside a pair of intervals the same recursion goes on by halves, and what is left is compared by blocked
matrix products in double precision.

Equal vectors become one row with a count first. A pair of blocks yields link counts a vector and the edges of a spanning
forest of its links, never the links themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths link with nothing; rows that repeat an id are vectors of their own; a null id counts as a vector and
as a component's id only if nothing else is in it; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hinted
from .components import components

LEADING = 8
#: Vectors of an interval; fan-out of the box tree.
INTERVAL, FAN = 2048, 16
#: Vectors below which a pair of runs is compared without splitting it further.
LEAF = 512


def _usable(kind: str):
    """Rows (vid, raw, dim) of the vectors that can be compared, as stored: "<f4" or "<f8"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            n = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = pc.fill_null(v.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            start, some = np.cumsum(n) - n, np.flatnonzero(n)
            if len(some):
                some = some[np.logical_and.reduceat(np.isfinite(x), start[some]) & np.logical_or.reduceat(x != 0, start[some])]
            raw, size = x.tobytes(), x.itemsize
            rows = [raw[a * size : (a + k) * size] for a, k in zip(start[some].tolist(), n[some].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vid").take(pa.array(some)), pa.array(rows, pa.binary()), pa.array(n[some].astype(np.int32))], names=["vid", "raw", "dim"])

    return run


def unit(rows: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(dim: int, kind: str):
    """Partial sums of the outer products of a task's vectors with 1 in front: a row for each row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = unit(batch.column("raw").to_pylist(), dim, kind)
            x = np.hstack([np.ones((len(x), 1)), x])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(list(total))], names=["row", "sums"])

    return run


def _cells(directions: bytes, mean: bytes, dim: int, kind: str, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, m = np.frombuffer(directions, np.float64).reshape(dim, -1), np.frombuffer(mean, np.float64)
        for batch in batches:
            y = (unit(batch.column("raw").to_pylist(), dim, kind) - m) @ q
            cell = np.floor(y / epsilon).astype(np.int64) + 128  # unit vectors: small numbers
            order = [struct.pack(f">{q.shape[1]}B", *np.clip(c, 0, 255)) for c in cell]
            yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("raw"), batch.column("copies"), pa.array(order, pa.binary()), pa.array(y[:, 0]), pa.array([r.tobytes() for r in y], pa.binary())], names=["vid", "raw", "copies", "cell", "along", "lead"])

    return run


_INTERVALS = "leaf long, level1 long, level2 long, level3 long, low array<double>, high array<double>, vids binary, copies binary, raws binary, leads binary"


def _intervals():
    """Consecutive intervals of a task's sorted vectors, with their boxes and their places in the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal seq
            vids, raws, copies, leads = zip(*rows)
            y = np.frombuffer(b"".join(leads), np.float64).reshape(len(rows), -1)
            leaf = part << 32 | seq
            level1, level2 = part << 32 | seq // FAN, part << 32 | seq // FAN**2
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([leaf]), pa.array([level1]), pa.array([level2]), pa.array([part]), pa.array([y.min(axis=0).tolist()]), pa.array([y.max(axis=0).tolist()]), *(pa.array([x], pa.binary()) for x in (np.array(vids, np.int64).tobytes(), np.array(copies, np.int64).tobytes(), b"".join(raws), b"".join(leads)))], names=[c.split()[0] for c in _INTERVALS.split(", ")])

        for batch in batches:
            held += zip(*(batch.column(n).to_pylist() for n in ("vid", "raw", "copies", "lead")))
            while len(held) >= INTERVAL:
                yield made(held[:INTERVAL])
                held = held[INTERVAL:]
        if held:
            yield made(held)

    return run


def _box_pairs(intervals: DataFrame, epsilon: float) -> DataFrame:
    """Pairs a <= b of intervals whose boxes are within epsilon, by descending the tree of boxes level by level."""
    boxes = intervals.select("leaf", "level1", "level2", "level3", (F.col("level3") / (FAN * FAN)).cast("long").alias("level4"), "low", "high")
    size = LEADING
    lows = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(size)]
    highs = [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(size)]
    levels = ["level4", "level3", "level2", "level1", "leaf"]

    def nodes(k: int) -> DataFrame:
        parent = F.col(levels[k - 1]) if k else F.lit(0)
        # level1 and level2 number nodes within a part, so a node is known by its part too
        return boxes.groupBy(F.col(levels[k]).alias("node"), parent.cast("long").alias("parent")).agg(*lows, *highs)

    pairs = None
    for k in range(len(levels)):
        a, b = nodes(k).alias("a"), nodes(k).alias("b")
        if pairs is None:
            joined = a.join(b, (F.col("a.parent") == F.col("b.parent")) & (F.col("a.node") <= F.col("b.node")))
        else:
            joined = pairs.alias("p").join(a, F.col("p.x") == F.col("a.parent")).join(b, (F.col("p.y") == F.col("b.parent")) & ((F.col("p.x") != F.col("p.y")) | (F.col("a.node") <= F.col("b.node"))))
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a.l{i}") - F.col(f"b.h{i}"), F.col(f"b.l{i}") - F.col(f"a.h{i}")), F.lit(2.0)) for i in range(size)), F.lit(0.0))
        pairs = joined.where(gap <= epsilon * epsilon * (1 + 1e-9)).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    return pairs


class _Forest:
    """Union by least index, for the links of one pair of intervals."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, mask: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
        made, up = [], self.up

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in np.flatnonzero(mask.any(axis=1)):
            a = root(rows[i])
            near = cols[mask[i]]
            for j in near[up[near] != a]:
                if (b := root(j)) != a:
                    made.append((int(rows[i]), int(j)))
                    lo, hi = min(a, b), max(a, b)
                    up[hi], a = lo, lo
                up[j] = a
        return made


def _joined(dim: int, kind: str, cosine: float, epsilon: float):
    """From an interval x (y is null) followed by its partners y, again and again. For each pair of intervals: rows (vid, null, links found) and rows (vid, other, null), the edges of a spanning forest."""

    def compare(a: tuple, b: tuple, same: bool) -> tuple[np.ndarray, np.ndarray, list]:
        (va, ca, xa, ya), (vb, cb, xb, yb) = a, b
        na, nb, forest, edges = np.zeros(len(va), np.int64), np.zeros(len(vb), np.int64), _Forest(len(va) + (0 if same else len(vb))), []
        shift = 0 if same else len(va)

        def descend(i: np.ndarray, j: np.ndarray) -> None:
            p, q = ya[i], yb[j]
            gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
            if gap @ gap > epsilon * epsilon * (1 + 1e-9):
                return
            if len(i) <= LEAF and len(j) <= LEAF:
                near = xa[i] @ xb[j].T >= cosine
                if same:
                    near &= i[:, None] < j[None, :]
                if near.any():
                    na[i] += near @ cb[j]
                    np.add.at(nb if not same else na, j, near.T @ ca[i])
                    edges.extend(forest.link(near, i, j + shift))
                return
            halves = lambda k: [k] if len(k) <= LEAF else [k[: len(k) // 2], k[len(k) // 2 :]]
            for s in halves(i):
                for t in halves(j):
                    if not same or s[0] <= t[-1]:
                        descend(s, t)

        descend(np.arange(len(va)), np.arange(len(vb)))
        ids = va if same else np.concatenate([va, vb])
        return na, nb, [(int(ids[s]), int(ids[t])) for s, t in edges]

    def read(c: dict[str, list], k: int) -> tuple:
        vids = np.frombuffer(c["vids"][k], np.int64)
        return vids, np.frombuffer(c["copies"][k], np.int64), unit([c["raws"][k]], dim, kind), np.frombuffer(c["leads"][k], np.float64).reshape(len(vids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vid", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
        own = None
        for batch in batches:
            for k in range(batch.num_rows):
                c = batch.slice(k, 1).to_pydict()
                if c["y"][0] is None:
                    own = read(c, 0)
                    continue
                same = c["x"][0] == c["y"][0]
                other = own if same else read(c, 0)
                na, nb, edges = compare(own, other, same)
                vids = [*own[0][na > 0].tolist(), *([] if same else other[0][nb > 0].tolist())]
                links = [*na[na > 0].tolist(), *([] if same else nb[nb > 0].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(vids + [e[0] for e in edges], pa.int64()), pa.array([None] * len(vids) + [e[1] for e in edges], pa.int64()), pa.array(links + [None] * len(edges), pa.int64())], schema=schema)

    return run


def cosine_links(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of every row. The id must be an integer."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2048)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    scratch, epsilon = Scratch(spark, "vectors"), float(np.sqrt(2 - 2 * cosine))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    h = [F.xxhash64(F.lit(k), F.col("v")).alias(f"h{k}") for k in range(2)]
    # Equal vectors are one class; their rank within the class is never needed, only how many there are.
    classes = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.write(classes.withColumn("vid", F.monotonically_increasing_id()), "classes")
    kind = "<f4" if df.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    units = scratch.write(classes.select("vid", "v").mapInArrow(_usable(kind), "vid long, raw binary, dim int"), "units")
    counted = units.join(classes.select("vid", "copies"), "vid")
    links = spark.createDataFrame([], "vid long, other long, links long")
    for dim in sorted(r["dim"] for r in units.select("dim").distinct().collect()):
        links = links.union(_links_of(counted.where(F.col("dim") == dim), dim, kind, cosine, epsilon, scratch))
    links = scratch.write(links, "links")
    labels = components(links.where(F.col("other").isNotNull()).select(F.col("vid").alias("a"), F.col("other").alias("b")), scratch)
    counts = links.where(F.col("links").isNotNull()).groupBy("vid").agg(F.sum("links").alias("links"))
    usable = classes.join(units.select("vid"), "vid", "left_semi").join(counts, "vid", "left").join(labels.withColumnRenamed("node", "vid"), "vid", "left")
    usable = scratch.write(usable.select(*h, "least_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "vid").alias("root")), "usable")
    # Vectors without links are their own components; only the others meet by root, which Spark may split where one is large.
    least = scratch.write(usable.where(F.col("links") > 0).groupBy("root").agg(F.min("least_id").alias("component")), "least")
    named = usable.join(hinted(least, 16), "root", "left").withColumn("component", F.coalesce("component", "least_id")).select("h0", "h1", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component")
    named = scratch.write(named, "named")
    id_type = df.schema[id_col].dataType
    out = rows.select("id", *h).join(named, ["h0", "h1"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").cast(id_type).alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast(id_type).alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links_of(units: DataFrame, dim: int, kind: str, cosine: float, epsilon: float, scratch: Scratch) -> DataFrame:
    sums = units.select("raw").mapInArrow(_moments(dim, kind), "row long, sums array<double>")
    total = sums.select("row", F.posexplode("sums").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")).collect()
    m = np.zeros((dim + 1, dim + 1))  # (dim + 1) squared numbers, whatever the number of vectors
    for r in total:
        m[r["row"], r["col"]] = r["x"]
    n, mean = max(m[0, 0], 1), m[0, 1:] / max(m[0, 0], 1)
    values, vectors = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
    directions = np.zeros((dim, LEADING))
    lead = vectors[:, np.argsort(-values)[:LEADING]]
    directions[:, : lead.shape[1]] = lead
    placed = units.select("vid", "raw", "copies").mapInArrow(_cells(directions.tobytes(), mean.tobytes(), dim, kind, epsilon), "vid long, raw binary, copies long, cell binary, along double, lead binary")
    ordered = placed.repartitionByRange("cell", "along", "vid").sortWithinPartitions("cell", "along", "vid")
    intervals = scratch.write(ordered.mapInArrow(_intervals(), _INTERVALS), f"intervals{dim}")
    pairs = scratch.write(_box_pairs(intervals, epsilon), f"pairs{dim}")
    # An interval travels once for each run of FAN consecutive intervals that hold partners, and each partner once.
    blobs = intervals.select("leaf", "level1", "vids", "copies", "raws", "leads")
    partners = blobs.join(pairs.withColumnRenamed("y", "leaf"), "leaf").select("x", F.col("level1").alias("run"), F.col("leaf").alias("y"), "vids", "copies", "raws", "leads")
    runs = pairs.join(intervals.select(F.col("leaf").alias("y"), "level1"), "y").select(F.col("x").alias("leaf"), F.col("level1").alias("run")).distinct()
    owners = blobs.join(runs, "leaf").select(F.col("leaf").alias("x"), "run", F.lit(None).cast("long").alias("y"), "vids", "copies", "raws", "leads")
    dealt = owners.unionByName(partners).repartition("x", "run").sortWithinPartitions("x", "run", F.col("y").asc_nulls_first())
    return dealt.mapInArrow(_joined(dim, kind, cosine, epsilon), "vid long, other long, links long")
