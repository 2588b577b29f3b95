"""Forward values of the token-level losses over exploded token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.stats import percentiles


def delta_weights(tokens: DataFrame, batch: str, value: str = "delta", mask: str = "mask", p: float = 0.95, name: str = "weight") -> DataFrame:
    """value clipped at its batch's percentile over the mask, divided by the clipped mean (1e-6 at least); 1 where the mask is empty.

    Two small aggregates by batch are joined back, so a batch needn't fit into a window.
    """
    on = F.when(F.col(mask), F.col(value))
    top = percentiles(tokens.select(batch, on.alias("__on")), "__on", [batch], {"__top": 100 * p})
    clipped = tokens.join(top, batch, "left").withColumn("__c", F.least(value, "__top"))
    mean = clipped.groupBy(batch).agg(F.avg(F.when(F.col(mask), F.col("__c"))).alias("__mean"))
    out = clipped.join(mean, batch)
    return out.withColumn(name, F.when(F.col("__mean").isNull(), 1.0).otherwise(F.col("__c") / F.greatest("__mean", F.lit(1e-6)))).drop("__top", "__c", "__mean")


def weighted_nll(logp: Column, delta: Column, passed: Column) -> Column:
    """-log p x weight, 0 where the trajectory failed; arrays of unequal length raise."""
    same = F.assert_true(F.size(logp) == F.size(delta), F.lit("log-probs and weights differ in length"))
    terms = F.zip_with(logp, delta, lambda l, d: F.when(passed, -l * d).otherwise(0.0))
    return F.when(same.isNull(), terms)


def branch_loss(kl: Column, logp: Column, is_ce: Column, beta: Column) -> Column:
    return F.when(is_ce, -logp * beta).otherwise(kl)


RECIPES = {"vanilla": (False, False), "delta": (True, False), "filtered": (False, True), "filtered_delta": (True, True)}


def recipe_loss(tokens: DataFrame, recipe: str) -> DataFrame:
    """tokens (mask, loss_branch, raw_kl, log_prob, weight, beta) with the loss of one of RECIPES; 0 off the mask."""
    if recipe not in RECIPES:
        raise KeyError(f"{recipe} is none of {sorted(RECIPES)}")
    weigh, sift = RECIPES[recipe]
    ce = (F.coalesce("loss_branch", F.lit("kl")) == "ce") if sift else F.lit(False)
    kl = F.col("raw_kl") * (F.coalesce("weight", F.lit(1.0)) if weigh else F.lit(1.0))
    return tokens.withColumn("loss", F.when(F.col("mask"), branch_loss(kl, F.col("log_prob"), ce, F.coalesce("beta", F.lit(0.1)))).otherwise(0.0))


def reward(df: DataFrame) -> DataFrame:
    return df.withColumn("reward", F.lit(0.0))
