"""A stored inverted index over learned centroids, and top-k search of many queries in one plan.

Vectors are dealt to cells by their nearest centroid (spherical k-means on a bounded sample) and stored in a folder a cell,
so a search that probes a few cells reads only their files; a cell with many vectors has many files of a bounded number
of rows. Every row is indexed: what has no direction (null, zero, of another length, not finite) is in cell -1, which no
probe reads, because its score is null.

Queries go through the vectors in passes of a bounded number of bytes. Each task multiplies its batches of vectors with a
pass's queries in double precision, a bounded number of scores at a time, and keeps the k best a query, ties by id; only
those are shuffled. The exact search does the same over all cells.

How many cells a search must probe depends on the data: near copies and topics share a cell, vectors without structure
do not. So `build` measures it: for a bounded sample of stored vectors it finds the exact neighbours and how far down the
list of nearest cells theirs are, and keeps the number of probes that reaches RECALL of them."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryflow.sources.scratch import Scratch

#: Rows that centroids are learned from, at most about; rows of a stored file, at most about.
SAMPLE, FILE_ROWS = 100_000, 250_000
#: Cells, at most, and bytes of the queries of one pass.
MOST_CELLS, PASS_BYTES = 4096, 16 << 20
#: Digits of a score that count in a comparison: products of equal vectors may differ in the last bits.
DIGITS = 12
#: What a score may lack before it is rounded; bytes of scores at once, and rows that a task always may hold.
SLACK, BLOCK_BYTES, HELD = 2e-12, 16 << 20, 200_000
NOWHERE = -1
#: Queries that the driver turns to unit vectors at once.
TURNED = 1024
#: The share of true neighbours that the kept number of probes reaches, of the K best of about TRIALS stored vectors.
RECALL, TRIALS, K = 0.95, 512, 10


def directions(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(n == dims) if dims else np.zeros(0, np.int64)
    flat = pc.fill_null(column.take(pa.array(right)).flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(right), dims) if dims else np.zeros((0, 0))
    size = np.abs(x).max(axis=1, initial=0.0)
    fine = np.isfinite(x).all(axis=1) & (size > 0)
    x = x[fine] / size[fine, None]  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), right[fine]


def _candidates(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that may be among the k best of their column, given what the k-th best must reach."""
    fits = scores >= least - SLACK
    if len(scores) > k and np.count_nonzero(fits) > 4 * k * scores.shape[1]:
        kth = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        fits = scores >= np.maximum(least, kth) - SLACK
    return np.nonzero(fits)


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k rows of each query by falling score, ties by id, in the order of the queries."""
    by = [("at", "ascending"), ("score", "descending"), ("id", "ascending")]
    found = found.take(pc.sort_indices(found, sort_keys=by, null_placement="at_start"))
    at = found.column("at").to_numpy()
    first = np.searchsorted(at, at)  # of the row's query
    return found.filter(pa.array(np.arange(len(at)) - first < k))


def _scan(rows: DataFrame, asked: list, matrix: np.ndarray, near: np.ndarray | None, k: int, id_type: T.DataType, query_type: T.DataType) -> DataFrame:
    """(query, id, score): each task's k best of each query. rows: id, vector, and cell if near is given, the cells of each
    query. A task holds at most about BLOCK_BYTES of scores, and a few times k rows a query of a pass."""
    from pyspark.sql.pandas.types import to_arrow_type

    dims = matrix.shape[1]
    fields = [T.StructField("query", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())]
    types = [to_arrow_type(f.dataType) for f in fields]
    most = max(HELD, 4 * k * len(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, np.full(len(asked), -np.inf)
        for batch in batches:
            x, at = directions(batch.column("vector"), dims)
            ids = batch.column("id").cast(types[1])
            cells = batch.column("cell").to_numpy(zero_copy_only=False)[at] if near is not None else np.zeros(len(at), np.int64)
            for cell in np.unique(cells):
                mine = np.flatnonzero(cells == cell)
                who = np.flatnonzero((near == cell).any(axis=1)) if near is not None else np.arange(len(asked))
                some = max(1, BLOCK_BYTES // 8 // max(1, len(who)))
                turned = matrix[who].T
                for part in (mine[i : i + some] for i in range(0, len(mine), some)):
                    scores = x[part] @ turned
                    r, c = _candidates(scores, least[who], k)
                    columns = [pa.array(who[c].astype(np.int32)), pa.array(np.round(scores[r, c], DIGITS)), ids.take(pa.array(at[part[r]]))]
                    held.append(pa.table(columns, names=["at", "score", "id"]))
                    n += len(r)
                    if n > most:
                        best = _best(pa.concat_tables(held), k)
                        held, n = [best], best.num_rows
                        q = best.column("at").to_numpy()
                        full = np.flatnonzero(np.bincount(q, minlength=len(asked)) >= k)
                        least[full] = best.column("score").to_numpy()[np.searchsorted(q, full, side="right") - 1]
        if n:
            best, names = _best(pa.concat_tables(held), k), pa.array(asked, types[0])
            for b in best.combine_chunks().to_batches(max_chunksize=10_000):
                yield pa.RecordBatch.from_arrays([names.take(b.column("at")), b.column("id"), b.column("score")], names=["query", "id", "score"])

    return rows.mapInArrow(run, T.StructType(fields))


def _passes(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Queries that have a direction, as many at a time as PASS_BYTES hold; those of another length than the first have none."""
    names, parts, dims, rows = [], [], 0, queries.select("query", "vector").toLocalIterator(prefetchPartitions=True)
    while some := list(islice(rows, TURNED)):
        dims = dims or next((len(r["vector"]) for r in some if r["vector"]), 0)
        x, at = directions(pa.array([r["vector"] for r in some], pa.list_(pa.float64())), dims)
        if len(at):
            names += [some[i]["query"] for i in at]
            parts.append(x)
        if len(names) * dims * 8 >= PASS_BYTES:
            yield names, np.concatenate(parts)
            names, parts = [], []
    if names:
        yield names, np.concatenate(parts)


def _top(parts: list[DataFrame], k: int, spark: SparkSession, schema: T.StructType) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_join(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query, id, score, rank) of the k vectors of greatest cosine for each query, ties by id: exact. queries: query,
    vector; vectors: id, vector. Queries and vectors without a direction have no rows; a repeated query needs a name of
    its own."""
    kinds = (vectors.schema["id"].dataType, queries.schema["query"].dataType)
    parts = [_scan(vectors.select("id", "vector"), names, matrix, None, k, *kinds) for names, matrix in _passes(queries)]
    schema = T.StructType([T.StructField("query", kinds[1]), T.StructField("id", kinds[0]), T.StructField("score", T.DoubleType())])
    return _top(parts, k, queries.sparkSession, schema)


def learn_cells(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centroids, by spherical k-means on about `sample` rows chosen by a hash of their ids, of which there may be any
    number. By default the root of the number of rows, at most MOST_CELLS and a sixth of the sample."""
    usable = vectors.where(F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0))
    lengths = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return np.zeros((0, 0))
    share = min(1.0, sample / lengths["count"])
    chosen = usable.where(F.size("vector") == lengths["n"]).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    points = chosen.select(array_to_vector("vector").alias("features"))
    wanted = cells or min(MOST_CELLS, math.ceil(math.sqrt(lengths["count"])))
    wanted = max(2, min(wanted, int(min(lengths["count"], sample)) // 6 if cells is None else wanted))
    model = KMeans(k=wanted, distanceMeasure="cosine", seed=seed, maxIter=15).fit(points)
    centres = np.array(model.clusterCenters())
    size = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    return centres[size[:, 0] > 0] / size[size[:, 0] > 0]


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]


@dataclass
class VectorIndex:
    """A stored index: the folder of its cells, its centroids (at most MOST_CELLS), and how many of them a search probes."""

    spark: SparkSession
    folder: str
    centres: np.ndarray
    schema: T.StructType
    probes: int = 1

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """vectors: id, vector and columns to filter by. Rows of a cell beyond FILE_ROWS go to files of their own."""
        spark, centres = vectors.sparkSession, learn_cells(vectors, cells, sample)
        dims = centres.shape[1]
        schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = np.full(batch.num_rows, NOWHERE, np.int32)
                x, at = directions(batch.column("vector"), dims)
                if len(at):
                    cell[at] = _nearest(x, centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        dealt = Scratch(spark, "cells").write(vectors.mapInArrow(deal, schema), "dealt")
        many = dealt.groupBy("cell").count().withColumn("parts", F.ceil(F.col("count") / FILE_ROWS).cast("int")).select("cell", "parts")
        split = dealt.join(F.broadcast(many), "cell").withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")))  # a row a cell
        stored = split.repartition("cell", "part").drop("parts", "part").write.mode("overwrite").partitionBy("cell")
        stored.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/cells")
        index = cls(spark, folder, centres, schema)
        index.probes = index._measured()
        model = spark.createDataFrame([(json.dumps(centres.tolist()), schema.json(), index.probes)], "centres string, schema string, probes int")
        model.coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
        return index

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> VectorIndex:
        model = spark.read.parquet(f"{folder}/model").first()
        centres = np.array(json.loads(model["centres"]))
        schema = T.StructType.fromJson(json.loads(model["schema"]))
        return cls(spark, folder, centres if centres.size else np.zeros((0, 0)), schema, model["probes"])

    def _measured(self) -> int:
        """The least number of probes with which RECALL of the sample's neighbours, itself left out, are found."""
        if not len(self.centres):
            return 1
        usable = self.rows().where(F.col("cell") != NOWHERE)
        share = min(1.0, TRIALS / max(1, usable.select(F.approx_count_distinct(F.xxhash64("vector"))).first()[0]))
        drawn = F.pmod(F.xxhash64(F.lit("trial"), "vector"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
        chosen = usable.where(drawn).groupBy("vector").agg(F.min("id").alias("own"))  # copies are one trial
        asked = chosen.select(F.monotonically_increasing_id().alias("query"), "own", "vector")
        asked = Scratch(self.spark, "trials").write(asked, "asked")
        found = self.search(asked.select("query", "vector"), K + 1, exact=True).join(asked.select("query", "own"), "query")
        cells = self.rows().select("id", "cell").distinct()
        hits = found.where("id IS DISTINCT FROM own").join(cells, "id").select("query", "cell").collect()  # about TRIALS * K
        place = {}
        for names, matrix in _passes(asked):
            for name, near in zip(names, _nearest(matrix, self.centres, len(self.centres))):
                place[name] = {int(cell): at for at, cell in enumerate(near)}
        ranks = sorted(place[h["query"]][h["cell"]] for h in hits)
        return ranks[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)))] + 1 if ranks else 1

    def rows(self, cells: set[int] | None = None) -> DataFrame:
        """The stored rows, of some cells only if they are given: the other folders are not read."""
        stored = self.spark.read.schema(self.schema).parquet(f"{self.folder}/cells")  # an empty table has no files
        return stored if cells is None else stored.where(F.col("cell").isin(*sorted(cells)) if cells else F.lit(False))

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False, where: Column | None = None) -> DataFrame:
        """(query, id, score, rank) of the k best of each query in its `probes` nearest cells (as many as `build` has found
        to be enough, by default), or of all vectors. where: a condition on the stored columns, applied before ranking."""
        parts = []
        kinds = (self.rows().schema["id"].dataType, queries.schema["query"].dataType)
        for names, matrix in _passes(queries):
            probed = not exact and self.centres.shape[1] == matrix.shape[1]  # of other lengths there is nothing to find
            near = _nearest(matrix, self.centres, probes or self.probes).astype(np.int32) if probed else None
            rows = self.rows(None if near is None else set(near.ravel().tolist()))
            rows = rows if where is None else rows.where(where)
            rows = rows.select("id", "vector", *(["cell"] if near is not None else []))
            parts.append(_scan(rows, names, matrix, near, k, *kinds))
        schema = T.StructType([T.StructField("query", kinds[1]), T.StructField("id", kinds[0]), T.StructField("score", T.DoubleType())])
        return _top(parts, k, self.spark, schema)
