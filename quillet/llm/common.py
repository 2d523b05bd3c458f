"""Shared plumbing of the corpus operators: inputs, durable cut points, UTF-8 batches as numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside joins and groups; results show null again.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Set while a cut point is written: Spark then removes the shuffle files of that job when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shared(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share: ``spark.checkpoint.dir`` or what the session set already. Only a
    local master may fall back to a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="quillet-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


@contextmanager
def _short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that all executors share."""
    _shared(df.sparkSession)
    with _short_lived_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under that setting


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as a Parquet table in the shared folder, for a value that only the block needs: it is deleted after it."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/{uuid.uuid4().hex}"
    with _short_lived_shuffles(spark):
        df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def keyed(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """With a key that is never null: null becomes NULL_ID."""
    return df.withColumn(name, F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)))


def unkeyed(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.nullif(F.col(name), F.lit(NULL_ID)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows, without copies; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(buf: np.ndarray, at: np.ndarray, most: int = 1 << 20):
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes each (one row at least): what a worker holds at once."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, buf[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, grown as longer buffers come."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            run = np.full(n, np.uint64(base & (2**64 - 1)))
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes (or of 64-bit numbers): equal content, equal hash, wherever it lies."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: By byte: 0 white space, 1 part of a word (letters, digits, anything beyond ASCII), 2 punctuation.
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes and of punctuation, and each run's row; no run crosses rows."""
    if len(buf) == 0:
        return (np.zeros(0, np.int64),) * 3
    kind = KIND[buf]
    change = np.empty(len(buf), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[at[:-1][at[:-1] < len(buf)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(buf))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(at, starts, "right") - 1


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space, and each run's row; no run crosses rows."""
    if len(buf) == 0:
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[buf]
    opens, closes = solid.copy(), solid.copy()
    cuts = at[:-1][(at[:-1] < len(buf)) & (at[:-1] > 0)]
    inside = np.ones(len(buf), bool)
    inside[cuts] = False
    opens[1:] &= ~(solid[:-1] & inside[1:])
    closes[:-1] &= ~(solid[1:] & inside[1:])
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(at, starts, "right") - 1
