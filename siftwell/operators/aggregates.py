"""Grouped metrics over records: accuracy, gains, overlaps, error inheritance, ranges, token sums. All are partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import arrays as A
from siftwell.functions import text as X
from siftwell.functions.stats import chance, confusion, finite, finite_mean, percentile, rate


def accuracy(df: DataFrame, *by: str, with_image: str = "correct_i", without: str = "correct_null") -> DataFrame:
    """n, acc_i, acc_null and their difference."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), rate(F.col(with_image)).alias("acc_i"), rate(F.col(without)).alias("acc_null"))
    return out.withColumn("delta_acc", F.col("acc_i") - F.col("acc_null"))


def split_means(df: DataFrame, value: str, correct: str, *by: str) -> DataFrame:
    """Means of a value over right and wrong rows, and the gap."""
    right, wrong = F.avg(F.when(F.col(correct), F.col(value))), F.avg(F.when(~F.col(correct), F.col(value)))
    out = df.groupBy(*by).agg(F.count_if(F.col(correct)).alias("n_correct"), F.count_if(~F.col(correct)).alias("n_wrong"), right.alias("mean_correct"), wrong.alias("mean_wrong"))
    return out.withColumn("gap", F.col("mean_correct") - F.col("mean_wrong"))


def visual_gain(df: DataFrame, *by: str, finite_only: bool = False, lengths: tuple[str, str] | None = None) -> DataFrame:
    """Mean gains (image minus no image) of the truth and of the bias, each over the rows that have it, and their margin.

    df has maps opt_i and opt_null. lengths names the token counts of both options; then per-token gains come too.
    """
    mean = finite_mean if finite_only else F.avg
    gt = F.try_element_at("opt_i", F.lit("ground_truth")) - F.try_element_at("opt_null", F.lit("ground_truth"))
    bias = F.try_element_at("opt_i", F.lit("expected_bias")) - F.try_element_at("opt_null", F.lit("expected_bias"))
    aggs = [F.count_if(gt.isNotNull()).alias("n_gt"), F.count_if(bias.isNotNull()).alias("n_bias"), F.count_if(gt.isNull() & bias.isNull()).alias("n_skipped"), mean(gt).alias("gain_gt"), mean(bias).alias("gain_bias")]
    if lengths:
        aggs += [mean(F.try_divide(gt, F.col(lengths[0]))).alias("gain_gt_per_token"), mean(F.try_divide(bias, F.col(lengths[1]))).alias("gain_bias_per_token")]
    out = df.groupBy(*by).agg(*aggs).withColumn("margin", F.col("gain_gt") - F.col("gain_bias"))
    return out.withColumn("margin_per_token", F.col("gain_gt_per_token") - F.col("gain_bias_per_token")) if lengths else out


def paired_margin(df: DataFrame, *by: str) -> DataFrame:
    """Margins over the rows that have both options with the image."""
    both = F.try_element_at("opt_i", F.lit("ground_truth")).isNotNull() & F.try_element_at("opt_i", F.lit("expected_bias")).isNotNull()
    return visual_gain(df.where(both), *by)


def error_overlap(matched: DataFrame, *by: str) -> DataFrame:
    """Of matched rows (correct, s_correct, answer, s_answer, gold): both wrong, same wrong answer, rate, answer space, chance, excess."""
    both = ~F.col("correct") & ~F.col("s_correct")
    out = matched.groupBy(*by).agg(
        F.count("*").alias("n_matched"), F.count_if(both).alias("both_wrong"), F.count_if(both & (F.col("answer") == F.col("s_answer"))).alias("same_wrong"), F.countDistinct(X.canonical(F.col("gold"))).alias("answer_space")
    )
    out = out.withColumn("same_rate", F.try_divide("same_wrong", "both_wrong")).withColumn("chance", chance(F.col("answer_space")))
    return out.withColumn("excess", F.col("same_rate") - F.col("chance"))


def grounding_gap(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean value of grounded (says yes, truth yes) and hallucinated (says yes, truth no) answers, and the gap."""
    yes, truth = X.says_yes(F.col("answer")), F.col("gold") == "yes"
    out = df.groupBy(*by).agg(
        F.count_if(yes & truth).alias("n_grounded"), F.count_if(yes & ~truth).alias("n_hallucinated"), F.avg(F.when(yes & truth, F.col(value))).alias("grounded"), F.avg(F.when(yes & ~truth, F.col(value))).alias("hallucinated")
    )
    return out.withColumn("gap", F.col("grounded") - F.col("hallucinated"))


def with_totals(df: DataFrame, group: str, pooled: Column) -> DataFrame:
    """Accuracy over all rows, by group, and over the pooled subset, in one pass of grouping sets."""
    flagged = df.select(F.col(group).alias("g"), pooled.alias("pool"), "correct_i", "correct_null")
    sets = flagged.groupingSets([[], [F.col("g")], [F.col("pool")]], F.col("g"), F.col("pool")).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), rate(F.col("correct_i")).alias("acc_i"), rate(F.col("correct_null")).alias("acc_null"))
    scope = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "group").otherwise("pooled")
    return sets.where((F.col("gid") != 2) | F.col("pool")).where((F.col("gid") != 1) | F.col("g").isNotNull()).select(scope.alias("scope"), F.col("g").alias("grp"), "n", "acc_i", "acc_null")


def inheritance(joined: DataFrame, *by: str) -> DataFrame:
    """Error inheritance of three-way rows (correct, answer, s_answer, s_correct, b_answer, b_correct).

    Over teacher-wrong rows with a student row: inherited is any non-empty student answer equal to the teacher's, right or not; a
    base answer counts only where the base is wrong; escaped is inherited by the base where the student is now right.
    """
    wrong = joined.where(~F.col("correct"))
    same = (F.col("s_answer") == F.col("answer")) & (F.col("s_answer") != "")
    base = F.coalesce((F.col("b_answer") == F.col("answer")) & (F.col("b_answer") != "") & ~F.col("b_correct"), F.lit(False))
    out = wrong.groupBy(*by).agg(F.count("*").alias("n"), rate(F.col("s_correct")).alias("acc_given_wrong"), F.count_if(same).alias("inherited"), F.count_if(base).alias("base_inherited"), F.count_if(base & F.coalesce("s_correct", F.lit(False))).alias("escaped"))
    return out.withColumn("tei_rate", F.try_divide("inherited", "n")).withColumn("escape_rate", F.try_divide("escaped", "base_inherited"))


def binary_confusion(df: DataFrame, pred: Column, gold: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in confusion(pred, gold).items()])


def length_stats(df: DataFrame, text: str, parsed: Column, *by: str) -> DataFrame:
    size = F.length(text).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(size).alias("mean_len"), percentile(size, 50).alias("p50"), percentile(size, 95).alias("p95"), rate(parsed).alias("parse_rate"))


def metric_ranges(series: DataFrame) -> DataFrame:
    """min, max, mean, last and n of the finite values of each metric of (metric, step, value)."""
    ok = series.where(finite(F.col("value")))
    return ok.groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.max_by("value", "step").alias("last"), F.count("*").alias("n"))


def conditional_rates(df: DataFrame, *by: str) -> DataFrame:
    """Accuracies overall, on counterfactual and canonical rows, and how often a wrong counterfactual answer is the prior's."""
    cf = F.col("is_counterfactual")
    wrong_cf = cf & ~F.col("correct")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), rate(F.col("correct")).alias("acc"), rate(F.when(cf, F.col("correct"))).alias("acc_cf"), rate(F.when(~cf, F.col("correct"))).alias("acc_canonical"),
        F.try_divide(F.count_if(wrong_cf & (F.col("answer") == F.col("prior"))), F.count_if(wrong_cf)).alias("prior_rate"),
    )


def count_by(df: DataFrame, *by: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def batch_sums(tokens: DataFrame, *by: str, eps: float = 1e-12) -> DataFrame:
    """Masked sums of token rows (mask, loss_branch, raw_kl, log_prob, weight, beta): tokens, samples and losses of both branches.

    A null branch is 'kl', a null weight 1, a null beta 0.1; the ratio is 0 where the total is at most eps.
    """
    ce = F.coalesce("loss_branch", F.lit("kl")) == "ce"
    kl_on, ce_on = F.col("mask") & ~ce, F.col("mask") & ce
    kl = F.coalesce(F.sum(F.when(kl_on, F.col("raw_kl") * F.coalesce("weight", F.lit(1.0)))), F.lit(0.0))
    nll = F.coalesce(F.sum(F.when(ce_on, -F.col("log_prob") * F.coalesce("beta", F.lit(0.1)))), F.lit(0.0))
    out = tokens.groupBy(*by).agg(F.count_if(kl_on).alias("kl_tokens"), F.count_if(ce_on).alias("ce_tokens"), F.countDistinct(F.when(ce, F.col("sample_id"))).alias("ce_samples"), kl.alias("kl_sum"), nll.alias("ce_sum"))
    whole = F.col("kl_sum") + F.col("ce_sum")
    return out.withColumn("kl_ce_ratio", F.when(F.abs(whole) <= eps, 0.0).otherwise(F.col("kl_sum") / F.when(F.abs(whole) <= eps, 1.0).otherwise(whole)))


def bucket_sums(tokens: DataFrame) -> DataFrame:
    """batch_sums by bucket ('unknown' for null) with the share of tokens whose teacher is right (missing counts as right)."""
    named = tokens.withColumn("bucket", F.coalesce("bucket", F.lit("unknown")))
    right = named.groupBy("bucket").agg(rate(F.when(F.col("mask"), F.coalesce("trajectory_pass", F.lit(True)))).alias("teacher_correct"))
    return batch_sums(named, "bucket").join(right, "bucket")


def weight_moments(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.var_samp(value)).alias("variance"))


def run_progress(df: DataFrame, passed: Column, began: Column, ended: Column, planned: int) -> DataFrame:
    """Rows done, pass rate, rows a second and seconds left of a run's records."""
    out = df.agg(F.count("*").alias("done"), rate(passed).alias("pass_rate"), (F.max(ended).cast("double") - F.min(began).cast("double")).alias("seconds"))
    out = out.withColumn("per_second", F.try_divide("done", "seconds"))
    return out.withColumn("seconds_left", F.try_divide(F.lit(planned) - F.col("done"), F.col("per_second")))


def mean_delta(df: DataFrame, series: str, name: str = "mean_delta") -> DataFrame:
    return df.withColumn(name, A.mean(F.col(series)))


def rates_of(df: DataFrame, named: Sequence[tuple[str, Column]], *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in named])
