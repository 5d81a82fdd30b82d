"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and is at most this large.
BROADCAST_BYTES = 32 << 20
#: Python workers go through Arrow batches in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, which only a local master may do, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if folder is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lorekeep-"))
            folder = context.getCheckpointDir()
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there and a
    lost executor takes nothing with it. The files go with ``discard``, or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, place = _file(spark, path)
    files.deleteOnExit(place)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def _file(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for table in tables:
        files, place = _file(table.sparkSession, table._stored_at)
        files.delete(place, True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit in BROADCAST_BYTES; else as it is, for a
    shuffled join. Pass stored tables only: the count runs at once."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def text_of(df: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 3; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, or of one row."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Returns freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with freed memory given back when a partition ends: workers outlive the stages of a job."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def row_tie(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed: rows that differ are told apart alike in every run."""
    return F.xxhash64(*(docs[f"`{f.name}`"] for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))))


def row_numbers() -> Iterator[int]:
    """Numbers for the rows of a task that no other task gives. They hold once the result is stored."""
    return itertools.count(TaskContext.get().partitionId() << 33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
