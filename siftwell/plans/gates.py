"""Verdicts over aggregates: rules as CASE expressions and small rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.sampling import last_step


def criteria_verdict(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each check as a column, how many hold, and GO at two or more, BORDERLINE at one, KILL at none. A null check holds for none."""
    out = row.select("*", *[c.alias(k) for k, c in checks.items()])
    met = sum((F.coalesce(F.col(k), F.lit(False)).cast("int") for k in checks), F.lit(0))
    out = out.withColumn("n_met", met)
    return out.withColumn("verdict", F.when(F.col("n_met") >= 2, "GO").when(F.col("n_met") == 1, "BORDERLINE").otherwise("KILL"))


def synth_verdict(acc_cf: Column, prior_rate: Column, easy: float = 0.80, weak: float = 0.30) -> Column:
    return F.when(acc_cf.isNull(), "INCONCLUSIVE").when(acc_cf >= easy, "FAIL too easy").when(prior_rate.isNull() | (prior_rate < weak), "FAIL weak prior").otherwise("PASS")


# Fixed values: (metric, lo, hi, severity, configurations it holds for).
HEALTH_RULES = (
    ("actor/e1_v1/delta_t_mean_post_norm", 0.95, 1.05, "warn", "BD"),
    ("actor/e1_v1/kl_ce_ratio", 0.3, 0.7, "fail", "CD"),
    ("actor/e1_v1/virl39k_kl_ce_ratio", 0.3, 0.7, "warn", "CD"),
    ("actor/e1_v1/pope_style_kl_ce_ratio", 0.3, 0.7, "warn", "CD"),
    ("actor/e1_v1/tallyqa_kl_ce_ratio", 0.3, 0.7, "warn", "CD"),
    ("actor/e1_v1/synthetic_kl_ce_ratio", 0.3, 0.7, "warn", "CD"),
    ("actor/loss", -1.7976931348623157e308, 99.99999999999999, "fail", "ABCD"),
    ("actor/distillation/loss", -1.7976931348623157e308, 99.99999999999999, "fail", "ABCD"),
)
FAILURE = "RuntimeError|RayTaskError|raise self\\._exception"


def health_findings(series: DataFrame, rules: Sequence[tuple[str, float, float, str, str]], config: str) -> DataFrame:
    """(metric, value, severity, ok) of the last step's values under the rules (metric, lo, hi, severity, configs) that name config.

    An absent metric gives no finding; a value that isn't finite fails its band.
    """
    spark = series.sparkSession
    mine = [r for r in rules if config in r[4]]
    table = F.broadcast(spark.createDataFrame(mine, "metric string, lo double, hi double, severity string, configs string"))
    ok = ~F.isnan("value") & F.col("value").between(F.col("lo"), F.col("hi"))
    return last_step(series).join(table, "metric").select("metric", "value", F.when(ok, "ok").otherwise(F.col("severity")).alias("severity"), ok.alias("ok"))


def gate_code(n_findings: int, failed: bool = False) -> int:
    """0 clean, 1 findings, 2 could not run."""
    return 2 if failed else int(n_findings > 0)


def failure_lines(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.agg(F.count_if(F.col("line").rlike(pattern)).alias("n_failures"), F.count("*").alias("n_lines"))


def branch(recipe: Column, teacher_right: Column) -> Column:
    """'ce' where the recipe filters and the teacher is wrong, else 'kl'; an unknown teacher counts as right."""
    return F.when(F.contains(recipe, F.lit("filtered")) & ~F.coalesce(teacher_right, F.lit(True)), "ce").otherwise("kl")


def uses_delta(recipe: Column) -> Column:
    return F.contains(recipe, F.lit("delta"))


def comparison(rows: dict[str, DataFrame]) -> DataFrame:
    """Metric rows of named configurations under one another."""
    from siftwell.operators.sets import concat_all

    return concat_all(*[df.select(F.lit(name).alias("config"), "*") for name, df in rows.items()])
