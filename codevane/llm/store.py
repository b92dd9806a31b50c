"""Shared storage for intermediate tables, and vectors summed over all tasks.

A table without rows is written and read as one; its sum is all zeros and its
filter lets nothing pass.  Null texts reach a task's function as nulls.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codevane.llm import wordhash

#: Entries of a vector that travel as one row.
PIECE = 512


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its process gives freed memory back to the system.

    Python workers serve many tasks; what their allocators keep for themselves
    would add up over the stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return run


#: Texts, and bytes of texts, that go to Python in one batch, where the session has Spark's own defaults.
BATCH, BATCH_BYTES = "2000", "16777216b"
DEFAULTS = {"maxRecordsPerBatch": ("10000", BATCH), "maxBytesPerBatch": ("67108864b", BATCH_BYTES)}


def bounded(spark: SparkSession) -> None:
    """Keeps batches of texts small, so that a worker's memory follows the bounds and not the rows of a file.

    These are settings of the session and stay for what it runs later; values
    that a user has chosen are left alone.
    """
    for name, (default, value) in DEFAULTS.items():
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, value)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and losing executors loses nothing."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def summed(df: DataFrame, vector: Callable[[Iterator[pa.RecordBatch]], np.ndarray], width: int) -> np.ndarray:
    """The sum over all tasks of an int64 vector of ``width`` entries that each task makes of its rows.

    Tasks send their vectors in pieces, which meet in as many tasks as a
    shuffle has; the driver gets one vector of a width fixed by the caller.
    """
    schema = "piece int, counts binary"
    out = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])

    def send(pieces: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for k, v in pieces:
            if v.any():
                keys.append(k)
                values.append(v.astype(np.int64).tobytes())
                held += 1
                if held >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], schema=out)
                    keys, values, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], schema=out)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vector(batches)
        yield from send((i // PIECE, v[i : i + PIECE]) for i in range(0, width, PIECE))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), np.int64)
                sums[k] = sums[k] + x if k in sums else x.copy()
        yield from send(iter(sums.items()))

    spark = df.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-width // PIECE))
    rows = df.mapInArrow(frugal(local), schema).repartition(parts, "piece").mapInArrow(total, schema).toArrow()
    sums = np.zeros(-(-width // PIECE) * PIECE, np.int64)
    for k, v in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        x = np.frombuffer(v.as_buffer(), np.int64)
        sums[k * PIECE : k * PIECE + len(x)] = x
    return sums[:width]


#: Keys that are sent as they are.
FEW = 1 << 17
#: A filter's bits for each key, and the bound on its size: 2**28 bits are 32 MB.
KEY_BITS, MOST_BITS = 16, 1 << 28


class Filter:
    """A Bloom filter of 64-bit keys with two hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        a = wordhash.mix(keys.astype(np.uint64))
        return (a & np.uint64(width - 1)).astype(np.int64), (wordhash.mix(a + np.uint64(1)) & np.uint64(width - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        width, out = 8 * len(self.bits), np.ones(len(keys), bool)
        for p in self.places(keys, width):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def filter_of(df: DataFrame, column: str) -> Filter:
    """A filter of all keys of a column: about one key in 200 more passes it while keys fit its bound.

    Beyond the bound more pass, which costs time and loses nothing.  Bits are
    shuffled by their place, so a task makes its own part of the filter only.
    """
    n = df.count()
    width = min(MOST_BITS, max(1 << 16, 1 << (KEY_BITS * n).bit_length()))
    piece = 1 << 15

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate(Filter.places(b.column(0).to_numpy(), width))
            yield pa.RecordBatch.from_arrays([pa.array((p // piece).astype(np.int32)), pa.array((p % piece).astype(np.int32))], names=["piece", "at"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for b in batches:
            pieces, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(pieces, kind="stable")
            ends = np.flatnonzero(np.diff(pieces[order], append=-1))
            start = 0
            for e in ends:
                k = int(pieces[order[e]])
                marks.setdefault(k, np.zeros(piece, np.uint8))[at[order[start : e + 1]]] = 1
                start = e + 1
        for k, v in marks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes()], pa.binary())], names=["piece", "counts"])

    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), width // piece)
    rows = df.select(column).mapInArrow(frugal(places), "piece int, at int").repartition(parts, "piece").mapInArrow(part, "piece int, counts binary").toArrow()
    bits = np.zeros(width // 8, np.uint8)
    for k, v in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        bits[k * piece // 8 : (k + 1) * piece // 8] = np.frombuffer(v.as_buffer(), np.uint8)
    return Filter(bits)


def passing(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose column may be among the keys: all that are, and a few others.

    Saves a join from shuffling rows that cannot match.  A key must not be null.
    """
    if keys.count() <= FEW:
        return df.join(F.broadcast(keys.select(F.col(key).alias(column)).distinct()), column, "left_semi").select(*df.columns)
    held = df.sparkSession.sparkContext.broadcast(filter_of(keys, key).bits)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(held.value)
        for b in batches:
            yield b.filter(pa.array(known.has(b.column(at).to_numpy())))

    return df.mapInArrow(frugal(run), df.schema)
