"""Run logs and the sanity gate of synthetic data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions.stats import rate
from siftwell.lifecycles.records import extra
from siftwell.operators.aggregates import conditional_rates, metric_ranges
from siftwell.plans.gates import HEALTH_RULES, health_findings, synth_verdict
from siftwell.streaming.logs import PREFIXES, last_by_step, log_series


def log_table(spark: SparkSession, path: str, prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    """(step, metric, value) of a log's files; of a step logged twice the later line counts."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return last_by_step(log_series(lines.select(F.struct("file", "block", "nth").alias("line_no"), F.col("value").alias("line")), prefixes))


def log_report(series: DataFrame, config: str | None = None, band: tuple[float, float] = (0.3, 0.7)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranges of each metric, findings of the last step, and one row (n_steps, first_step, last_step).

    Without a config all rules hold. A log without a step is a failure.
    """
    rules = [(m, *(band if m.endswith("kl_ce_ratio") else (lo, hi)), severity, configs) for m, lo, hi, severity, configs in HEALTH_RULES]
    steps = series.agg(F.countDistinct("step").alias("n_steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))
    none = steps.where("n_steps = 0").select(F.lit("step_count").alias("metric"), F.lit(0.0).alias("value"), F.lit("fail").alias("severity"), F.lit(False).alias("ok"))
    return metric_ranges(series), health_findings(series, rules, config or "").unionByName(none), steps


def synth_report(records: DataFrame, easy: float = 0.80, weak: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """(topic, n, accuracy) of a teacher's records on synthetic data, and one row of the animal figures with the gate's verdict."""
    rows = records.withColumn("topic", F.coalesce(F.nullif(extra("topic"), F.lit("")), F.lit("unknown")))
    topics = rows.groupBy("topic").agg(F.count("*").alias("n"), rate(F.col("correct")).alias("accuracy"))
    animals = rows.where("topic = 'animal'").select(
        "correct", F.coalesce(extra("is_counterfactual", "boolean"), F.lit(False)).alias("is_counterfactual"), X.last_integer(F.col("text")).alias("answer"), extra("canonical_legs", "bigint").alias("prior")
    )
    cf, wrong = F.col("is_counterfactual"), F.col("is_counterfactual") & ~F.col("correct")
    counts = animals.agg(F.count_if(cf).alias("n_counterfactual"), F.count_if(~cf).alias("n_canonical"), F.count_if(wrong).alias("n_teacher_wrong_on_counterfactual"), F.count_if(wrong & (F.col("answer") == F.col("prior"))).alias("prior_trigger_count"))
    names = {"acc_cf": "accuracy_on_counterfactual", "acc_canonical": "accuracy_on_canonical", "prior_rate": "prior_trigger_rate"}
    gate = counts.join(conditional_rates(animals).select(*[F.col(a).alias(b) for a, b in names.items()]))  # one row each
    return topics, gate.withColumn("verdict", synth_verdict(F.col("accuracy_on_counterfactual"), F.col("prior_trigger_rate"), easy, weak))
