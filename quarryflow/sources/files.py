"""Scans of source trees, table sinks, and small results at the edge."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {name: table(spark, sf_dir, name) for name in TABLES}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def scan_sources(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, content) of all matching files below root, by path; content is null for files that are not UTF-8."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select("path", text.alias("content")).orderBy("path")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")


def save_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrites a table, so rebuilding is idempotent."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def import_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """What `export_json` has written."""
    return spark.read.schema(ddl).json(path)


def reload_table(df: DataFrame, rows: DataFrame, path: str) -> None:
    """Empties a table and loads rows, null where they lack a column."""
    rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)).write.mode("overwrite").parquet(path)


def read_jdbc(spark: SparkSession, url: str, query: str, user: str, password: str, timeout_sec: int = 10) -> DataFrame:
    """A read-only query of an outside database; needs its driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, user=user, password=password, queryTimeout=timeout_sec).load()


def latest_manual(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the newest manual_*.md of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "manual_*.md").load(folder)
    newest = files.agg(F.max_by(F.struct("path", F.col("content").cast("string").alias("content")), F.struct("modificationTime", "path")).alias("m"))
    return newest.where("m IS NOT NULL").select("m.*")


def save_manual(spark: SparkSession, folder: str, text: str, generated_at: str) -> str:
    """Writes manual_<time>.md of an ISO time and returns its path."""
    path = f"{folder.rstrip('/')}/manual_{generated_at.replace(':', '').replace('-', '').replace('.', '_')}.md"
    return _put(spark, path, text)


def _put(spark: SparkSession, path: str, text: str) -> str:
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def procedure_cache(text: str | None) -> dict[str, dict]:
    """A saved cache by URL; what cannot be read is empty."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def save_procedures(spark: SparkSession, path: str, cache: dict[str, dict]) -> None:
    """Saves what `procedure_cache` reads."""
    _put(spark, path, json.dumps(cache, ensure_ascii=False, indent=2))


def with_cached(urls: DataFrame, cache: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs with their cached procedure, null where none is stored. Spark broadcasts the cache if its size allows it."""
    return urls.join(cache.select(F.col("url").alias(url_col), "procedure", "generated_at"), url_col, "left")


def as_records(df: DataFrame) -> list[dict]:
    """A small result as a list of dictionaries, for display."""
    return [r.asDict(recursive=True) for r in df.collect()]
