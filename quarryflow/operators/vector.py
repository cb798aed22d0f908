"""Chunk texts, embeddings and exact cosine search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryflow.functions.scalar import last_segment, line_slice

from .graph import downstream_tables, method_id, sql_id

#: Fixed values of chunk headers and prefixes; the other labels of a header stand where they are used.
LAYER_LABEL = {"CONTROLLER": "Controller", "SERVICE_IMPL": "ServiceImpl"}
PASSAGE, QUERY = "passage: ", "query: "


def _tables_line(tables: Column) -> Column:
    return F.when(F.size(tables) > 0, F.concat(F.lit("관련 테이블: "), F.array_join(tables, ", ")))


def method_chunks(classes: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, layer, class_name, method_name, file_path, lines, url, tables, text of controller and implementation methods."""
    rows = classes.where(F.col("layer").isin(*LAYER_LABEL)).select("layer", "class_name", "file_path", F.explode("methods").alias("m"))
    rows = rows.withColumn("node_id", method_id(F.col("layer"), F.col("class_name"), F.col("m.method_name")))
    tables = downstream_tables(nodes, edges, rows.select(F.col("node_id").alias("id")).distinct()).withColumnRenamed("id", "node_id")
    rows = rows.join(tables, "node_id").join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    layer = F.lit(None).cast("string")
    for k, v in LAYER_LABEL.items():
        layer = F.when(F.col("layer") == k, F.lit(v)).otherwise(layer)
    note = F.trim(F.regexp_replace(F.trim("m.leading_comment"), r"^[/*]+|[/*]+$", ""))
    code = line_slice("content", F.col("m.start_line"), F.col("m.end_line"))
    text = F.concat_ws("\n", F.concat(F.lit("계층: "), layer, F.lit(" | 클래스: "), "class_name", F.lit(" | 메서드: "), F.col("m.method_name")), F.concat(F.lit("URL: "), F.col("m.url")), F.concat(F.lit("주석: "), note), _tables_line(F.col("tables")), F.lit("---"), code)
    return rows.select("node_id", "layer", "class_name", F.col("m.method_name").alias("method_name"), "file_path", F.col("m.start_line").alias("start_line"), F.col("m.end_line").alias("end_line"), F.col("m.url").alias("url"), "tables", text.alias("text"))


def sql_chunks(statements: DataFrame) -> DataFrame:
    mapper = last_segment("namespace")
    text = F.concat_ws("\n", F.concat(F.lit("계층: SQL | Mapper: "), mapper, F.lit(" | SQL ID: "), "sql_id"), F.concat(F.lit("유형: "), "sql_type"), _tables_line(F.col("referenced_tables")), F.concat(F.lit("XML 파일: "), "file_path"), F.lit("---"), F.col("sql_text"))
    return statements.select(sql_id().alias("node_id"), F.lit("SQL").alias("layer"), mapper.alias("class_name"), F.col("sql_id").alias("method_name"), "file_path", "start_line", "end_line", F.lit(None).cast("string").alias("url"), F.col("referenced_tables").alias("tables"), text.alias("text"))


#: Texts that go to the embedding model at once.
BATCH = 16


def hashed_bag(texts: list[str], dim: int = 256) -> np.ndarray:
    """A stand-in backend: signed hashed counts of words, L2-normalised; the same text always gives the same vector."""
    words = [text.lower().split() for text in texts]
    known = sorted({w for row in words for w in row})
    h = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in known], np.uint64)
    at = {w: i for i, w in enumerate(known)}
    flat = np.array([at[w] for row in words for w in row], np.int64)
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    out = np.zeros((len(texts), dim), np.float32)
    if len(flat):
        np.add.at(out, (row, (h[flat] % np.uint64(dim)).astype(np.int64)), np.where(h[flat] >> np.uint64(63), 1.0, -1.0).astype(np.float32))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, text: str = "text", prefix: str = PASSAGE, backend: Callable[[list[str]], np.ndarray] = hashed_bag, out: str = "embedding") -> DataFrame:
    """The rows with a vector of the prefixed text, BATCH texts a call of the backend; null text is empty."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        ready = [prefix + (t or "") for t in texts]
        return pd.Series([v for i in range(0, len(ready), BATCH) for v in backend(ready[i : i + BATCH])])

    return df.withColumn(out, vectors(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a norm is 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(vectors: DataFrame, query: list[float], k: int = 5, layer: str | None = None, id_col: str = "node_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of greatest cosine, filtered before ranking; ties by id. score = cosine."""
    rows = vectors.where(F.col("layer") == layer) if layer else vectors
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = math.sqrt(sum(float(x) * float(x) for x in query))
    score = F.try_divide(dot(F.col(vector_col), q), F.sqrt(dot(F.col(vector_col), F.col(vector_col))) * F.lit(norm))
    return rows.withColumn("score", score).orderBy(F.col("score").desc_nulls_last(), id_col).limit(k)


def examples(manual: DataFrame, mandatory: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """Few-shot statements (node_id, text): the manual one, the mandatory one, then hits by score that are neither,
    until k besides the manual one."""
    ranked = hits.join(mandatory.select("node_id"), "node_id", "left_anti").orderBy(F.desc("score"), "node_id").limit(k - 1)
    pick = lambda df, at: df.select(F.lit(at).alias("tier"), "node_id", "text")
    return pick(manual, 0).unionByName(pick(mandatory, 1)).unionByName(pick(ranked, 2))
