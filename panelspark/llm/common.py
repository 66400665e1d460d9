"""Shared helpers of the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import scratch_path

WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_records: list[list[str]] = []


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read twice, survives lost executors.

    What it was made from is not needed again, so its shuffle files go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for paths in _records:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables written inside the block."""
    paths: list[str] = []
    _records.append(paths)
    try:
        yield paths
    finally:
        _records.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def named(df: DataFrame, column: str) -> Column:
    """A column by its exact name, dots included."""
    return df[f"`{column}`"]


def extended(df: DataFrame, left_out: str, added: str) -> T.StructType:
    """The schema of ``df`` without one column and with those of a DDL string."""
    kept = [f for f in df.schema.fields if f.name != left_out]
    return T.StructType([*kept, *T.StructType.fromDDL(added).fields])


def worker_state(key: tuple, build: Callable):
    """An object kept for the life of a Python worker, so tasks share compiled tables.

    Task functions travel by value and bring fresh globals, so the store hangs
    on the ``sys`` module.
    """
    store = sys.__dict__.setdefault("_panelspark_worker_state", {})
    if key not in store:
        store[key] = build()
    return store[key]


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixing function (multiply and shift), element by element."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end and the offsets of the rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def row_slices(offsets: np.ndarray, limit: int, most: int = 1024) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes and ``most`` rows; a longer row stands alone, whole."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + most, rows)
        yield first, last
        first = last


def id_crc(identifier: Column) -> Column:
    """crc32 of the decimal id as text."""
    return F.crc32(identifier.cast("string").cast("binary"))
