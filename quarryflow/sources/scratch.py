"""Tables that several steps read, written once to the shared folder, so that lost executors cost no recomputation."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where tables go if the session names no shared folder and all its executors are on this machine, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_left: list[tuple[object, object, str]] = []  # JVM, its Hadoop configuration, folder
_blocks = threading.local()  # of each thread, the lists of the blocks that it is in


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset and the
    master is local. A cluster without one is an error: its executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def _tidy(folders: list[tuple[object, object, str]]) -> None:
    while folders:
        jvm, conf, path = folders.pop()
        try:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now; the folder is temporary anyway
            continue


atexit.register(_tidy, _left)


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables that this thread writes inside go at the end of the block, also if it fails: what is read later must have been
    written elsewhere. Blocks may stand in each other; other threads' tables stay."""
    own: list[tuple[object, object, str]] = []
    stack = _blocks.__dict__.setdefault("stack", [])
    stack.append(own)
    try:
        yield
    finally:
        stack.pop()
        _tidy(own)


class Scratch:
    """A folder of written tables. It goes with its block of `temporary_tables`, or when the interpreter ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/quarryflow-{name}-{uuid.uuid4().hex}"
        stack = _blocks.__dict__.get("stack")
        held = stack[-1] if stack else _left
        held.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The table, read back. Its shuffle files go when it is written, not when the driver's memory happens to be tidied."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)
