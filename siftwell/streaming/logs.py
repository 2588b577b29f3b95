"""Training logs: parsed once as a batch, or followed as a stream (an extension)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from siftwell.functions import text as X
from siftwell.operators.filters import prefixed
from siftwell.operators.windows import keep_last

# Metric families that are kept.
PREFIXES = (
    "actor/e1_v1/",
    "actor/distillation/",
    "actor/loss",
    "actor/grad_norm",
    "actor/policy_loss",
    "actor/kl_loss",
    "actor/entropy_loss",
    "response_length/",
    "training/epoch",
    "training/global_step",
    "perf/",
)


def log_series(lines: DataFrame, prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    """(step, metric, value, line_no) of lines (line_no, line) that name a step."""
    rows = lines.withColumn("step", X.log_step(F.col("line"))).where("step IS NOT NULL")
    pairs = rows.select("step", "line_no", F.explode(X.log_entries(F.col("line"))).alias("e")).select("step", "e.metric", "e.value", "line_no")
    return pairs.where(F.col("value").isNotNull() & prefixed(F.col("metric"), prefixes))


def last_by_step(series: DataFrame) -> DataFrame:
    """Of a step logged twice the later line counts."""
    return keep_last(series, ["step", "metric"], ["line_no"]).drop("line_no")


#: A line's place: later files come after earlier ones, then names, blocks of a file and lines of a block.
PLACE = ("modified", "file", "block", "nth")
_STORES = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_RANGES = "metric string, min double, max double, mean double, last double, n bigint"


class RunningRanges(StatefulProcessor):
    """Ranges of one metric: the value of each step, and what they come to. A step that is logged again replaces its value, whatever
    that was; only then are the ranges worked out from all steps. State grows with the number of steps, not of lines."""

    def init(self, handle) -> None:
        self.steps = handle.getMapState("steps", "step bigint", "value double")
        self.sums = handle.getValueState("sums", "n bigint, total double, low double, high double, at bigint, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[int, tuple] = {}
        for part in rows:
            for step, value, *place in part[["step", "value", *PLACE]].itertuples(index=False, name=None):
                if step not in newest or tuple(place) > newest[step][1]:
                    newest[step] = (float(value), tuple(place))
        now = self.sums.get() if self.sums.exists() else (0, 0.0, None, None, None, None)
        replaced = False
        for step, (value, _) in newest.items():
            replaced |= self.steps.containsKey((step,))
            self.steps.updateValue((step,), (value,))
            now = self._with(now, step, value)
        if replaced:
            now = (0, 0.0, None, None, None, None)
            for (step,), (value,) in self.steps.iterator():
                now = self._with(now, step, value)
        self.sums.update(now)
        n, total, low, high, _, last = now
        yield pd.DataFrame({"metric": [key[0]], "min": [low], "max": [high], "mean": [total / n if n else None], "last": [last], "n": [n]})

    @staticmethod
    def _with(now: tuple, step: int, value: float) -> tuple:
        n, total, low, high, at, last = now
        if not math.isfinite(value):
            return now
        newer = at is None or step > at
        return n + 1, total + value, value if low is None else min(low, value), value if high is None else max(high, value), step if newer else at, value if newer else last

    def close(self) -> None:
        pass


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number among those of their block of a file."""
    seen: dict[tuple, int] = {}
    for b in batches:
        nth = []
        for place in zip(*(b.column(c).to_pylist() for c in ("modified", "file", "block"))):
            nth.append(seen.get(place, 0))
            seen[place] = nth[-1] + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth, pa.int64())], names=[*b.schema.names, "nth"])


def follow_ranges(spark: SparkSession, folder: str, table: str):
    """A started stream over a folder of logs, whose state keeps the value of each metric's steps. Each micro-batch writes the ranges of
    the metrics that it saw; followed_ranges reads the newest of each.

    The state is that of the last batch that was finished, and a batch that runs again overwrites what it wrote, so no line counts twice.
    """
    meta = F.col("_metadata")
    lines = spark.readStream.text(folder).select(meta.file_modification_time.cast("double").alias("modified"), meta.file_path.alias("file"), meta.file_block_start.alias("block"), F.col("value").alias("line"))
    numbered = lines.mapInArrow(_numbered, "modified double, file string, block bigint, line string, nth bigint")
    series = log_series(numbered.withColumn("line_no", F.struct(*PLACE))).select("metric", "step", "value", "line_no.*")
    ranges = series.groupBy("metric").transformWithStateInPandas(RunningRanges(), _RANGES, "Update", "None")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    before = {k: spark.conf.get(k, None) for k in _STORES}
    for k, v in _STORES.items():
        spark.conf.set(k, v)
    try:
        return ranges.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{table}-state").start()
    finally:  # the stream keeps the settings that it started with
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def followed_ranges(spark: SparkSession, table: str) -> DataFrame:
    """Ranges as of a log read as one batch: of a step logged twice the later line counts, in the order of micro-batches and lines. A
    row for each metric and micro-batch is read, not the log."""
    ranges = spark.read.schema(f"{_RANGES}, epoch bigint").parquet(table)
    return keep_last(ranges, ["metric"], ["epoch"]).drop("epoch").where("n > 0")


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "6 hours") -> DataFrame:
    """(start, event_type, n, total): event-time windows with a watermark; the same plan for a stream or a table."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
