"""What the corpus operators share: staged tables in the cluster's shared folder and small guards."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these; bytes.split() cuts at exactly these bytes.
WORD_BREAK = r"[\x20\x09-\x0D]+"

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset, as tests do."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="siftwell-")
    return _own_root


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once and read it back: cuts lineage, survives lost executors, keeps later passes from recomputing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table that no plan will read again."""
    path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged._staged_at)
    path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500, megabytes: int = 32) -> None:
    """Bound what one Arrow batch of whole texts can hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete shuffle files that no plan refers to any more; it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text: Column) -> Column:
    """Array of words of a text; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has at most so many rows, which is checked here; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_bytes(df: DataFrame, rows: int, width: Column, most: int) -> DataFrame:
    """bounded, where the sum of the rows' widths, in bytes, has a bound, too."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


_caches: list[dict] = []


def worker_cache() -> dict:
    """A dict that lives as long as its Python worker, until a task of another operator needs the memory."""
    _caches.append({})
    return _caches[-1]


def drop_caches() -> None:
    """Empty the worker's caches and hand freed memory back to the system, as a worker outlives its tasks."""
    for c in _caches:
        c.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
