"""What the operators share: the shared folder, cutting lineage, and reading tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1024
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and there is one machine only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        _fallback[key] = "file://" + tempfile.mkdtemp(prefix="tagwell-")
        spark.sparkContext.setCheckpointDir(_fallback[key])
    return _fallback[key]


def tidy(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps that are over: it does so once the driver's objects for them are collected, so collect them now and not when memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that few of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Give freed memory of a Python worker back to the system, for the worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that nothing above is computed again and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    tidy(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Have rows with whole texts go to Python workers and back some at a time: a batch is held on both sides, for each task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_partitions(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a file or folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
