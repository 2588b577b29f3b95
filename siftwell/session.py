"""Session settings the engine relies on, and scratch space that all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def build_session(master: str | None = "local[*]", shuffle_partitions: int | None = 8, **conf: str) -> SparkSession:
    """ANSI on, last value wins on repeated map keys, UTC, adaptive execution. None leaves the master, or the number of shuffle
    partitions, to what the session is submitted with."""
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder if master is None else SparkSession.builder.master(master)
    return builder.config(map=settings | conf).getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under spark.checkpoint.dir. Only a local master may leave it unset, as tests do; it gets a folder of its own."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        _own_root = _own_root or "file://" + tempfile.mkdtemp(prefix="siftwell-")
        root = _own_root
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written once to scratch space and read from there: for small tables that several steps need."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
