"""Helpers of the operators in this package: Arrow batches, written steps, word splitting."""

from __future__ import annotations

import gc
import sys
import time
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from longitab.sources.shared import shared_folder

#: Text bytes that one Arrow batch of a Python stage may hold, so that very long texts stay apart.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to bounded bytes; smaller settings stay."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    This cuts lineage and keeps columns prunable. Shuffle files of the finished step are let go
    as soon as the driver has collected its plan, so the collectors are called once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps that nothing in the caller refers to. The Java
    sides of collected Python objects are dropped by a thread that looks once a second."""
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def worker_cache() -> dict:
    """What a Python worker keeps from task to task. The functions of this library travel by value,
    so their modules' own globals are new in every task."""
    return vars(sys.modules.setdefault("longitab_worker", types.ModuleType("longitab_worker")))


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` text bytes each; a longer text is alone. Between
    batches, memory that Arrow no longer uses goes back to the system."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
        pa.default_memory_pool().release_unused()


def together(batches: Iterator[pa.RecordBatch], text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about ``limit`` text bytes, eight of them at most, and cut where they hold more."""
    kept, size = [], 0
    for batch in pieces(batches, text, limit):
        more = batch.column(text).nbytes
        if kept and (size + more > limit or len(kept) == 8):
            yield pa.concat_batches(kept)
            kept, size = [], 0
        kept.append(batch)
        size += more
    if kept:
        yield pa.concat_batches(kept)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
