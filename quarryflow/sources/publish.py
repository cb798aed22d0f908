"""Versions of a set of tables, of which readers see a whole one.

Each version has a folder of its own, and a small pointer file names the current one. The pointer moves last, by a rename
that replaces it in one step, so a build that dies leaves the old version readable, and readers that have begun keep their
files until old versions are dropped."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import SparkSession

POINTER, VERSIONS = "CURRENT", "versions"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the current version; None if there is none."""
    pointer = _path(spark, root, POINTER)
    if not _files(spark, pointer).exists(pointer):
        return None
    stream = _files(spark, pointer).open(pointer)
    try:
        named = bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()
    return f"{root.rstrip('/')}/{VERSIONS}/{named}"


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Lets `write` fill a new version's folder, then makes it the current one. Returns the folder. If `write` fails, the
    unfinished folder goes and the old version stays."""
    name = f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    folder = _path(spark, root, VERSIONS, name)
    try:
        write(folder.toString())
    except BaseException:
        _files(spark, folder).delete(folder, True)
        raise
    ready, pointer = _path(spark, root, f".{POINTER}-{name}"), _path(spark, root, POINTER)
    out = _files(spark, ready).create(ready, True)
    out.write(bytearray(name.encode()))
    out.close()
    where = _files(spark, ready).getUri()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where, spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(ready, pointer, options)
    return folder.toString()


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Drops all but the newest `keep` versions and the current one; their names."""
    folder, named = _path(spark, root, VERSIONS), current(spark, root)
    files = _files(spark, folder)
    if not files.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory())
    gone = [n for n in names[: max(0, len(names) - keep)] if not (named or "").endswith(f"/{n}")]
    for n in gone:
        files.delete(_path(spark, root, VERSIONS, n), True)
    return gone
