"""Shared helpers of the training-data operators: word rule, shared-folder tables, Arrow batch limits."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.sources.scratch import Scratch  # noqa: F401  the operators take it from here

#: A word is a maximal run of anything but ASCII white space. ``bytes.split()`` splits by the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def arrow_limits(spark: SparkSession, records: int = 1024, mib: int = 2) -> None:
    """Bound what a Python worker holds at once; documents can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mib << 20)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Memo(dict):
    """A bounded cache of a pure function of short strings. It keeps two generations of `entries` each: what the older one
    still knows moves over when asked for, so common strings stay and memory is constant."""

    def __init__(self, make: Callable, entries: int = 120_000, longest: int = 40):
        super().__init__()
        self.make, self.entries, self.longest, self.older = make, entries, longest, {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_held: dict = {}


def held(key: tuple, make: Callable):
    """The object of a key, of which a worker keeps one at a time: the tables of one model make room for the next one's."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def tidied(run: Callable) -> Callable:
    """A batch function that hands unused memory back when its task ends, since workers stay between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, arrow_schema: pa.Schema) -> DataFrame:
    """fn gets the columns of an Arrow batch as lists and returns the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}), schema=arrow_schema)

    return df.mapInArrow(tidied(run), schema)


#: A written table is broadcast up to this size; beyond it the join shuffles both sides.
BROADCAST_BYTES = 24 << 20


def hinted(table: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table already written, marked for broadcast only if its checked size (bytes a row, summed) allows it."""
    size = table.count() * row_bytes if isinstance(row_bytes, int) else table.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(table) if size <= limit else table
