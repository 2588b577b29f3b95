"""Window-like operators: first or last of a key, ranks within strata, batch quantiles, round-robin shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.stats import percentiles


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in a full order. An aggregate, not a window: a hot key is reduced before the shuffle."""
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def stable_order(seed: int, *keys: Column | str) -> Column:
    """A pseudo-random order that any engine repeats: md5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]))


def stratum_head(df: DataFrame, stratum: str, key: str, quota: Column, seed: int = 42) -> DataFrame:
    """The first quota rows of each stratum in shuffled order."""
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(stable_order(seed, key), key))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= quota).drop("__nth")


def clip_at_quantile(df: DataFrame, value: str, batch: str, p: float = 0.95, name: str = "clipped") -> DataFrame:
    """value, at most its batch's percentile: percentiles by batch, joined back."""
    top = percentiles(df, value, [batch], {"__top": 100 * p})
    return df.join(top, batch).withColumn(name, F.least(value, "__top")).drop("__top")


def round_robin(df: DataFrame, shards: int, *order: str) -> DataFrame:
    """shard: place in a pinned order modulo shards."""
    from siftwell.operators.projections import row_index

    return row_index(df, *order, name="__i").withColumn("shard", F.col("__i") % shards).drop("__i")
