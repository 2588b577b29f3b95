"""Filters, and the account of what they reject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions.stats import finite


def in_range(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Inclusive; a bound may be left out."""
    out = F.lit(True)
    if lo is not None:
        out = out & (c >= lo)
    return out if hi is None else out & (c <= hi)


def single(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) == 1


def not_simple(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def non_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def non_blank(c: Column) -> Column:
    return X.strip(F.coalesce(c, F.lit(""))) != ""


def source_in(c: Column, names: Sequence[str]) -> Column:
    return F.coalesce(F.lower(c), F.lit("")).isin(*[n.lower() for n in names])


def integer_in(c: Column, lo: int, hi: int) -> Column:
    return F.coalesce(c.try_cast("bigint").between(lo, hi), F.lit(False))


def at_least(c: Column, n: int) -> Column:
    return F.size(c) >= n


def prefixed(c: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def with_reject_reason(df: DataFrame, checks: Sequence[tuple[str, Column]], name: str = "reject_reason") -> DataFrame:
    """name: the first check in order that a row fails (or that is null on it), null if it passes all."""
    reason = None
    for what, ok in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, what) if reason is None else reason.when(bad, what)
    return df.withColumn(name, reason)


def reject_counts(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """(reason, n): rows by their first failing check, 'kept' for the rest. One pass, one small shuffle."""
    return with_reject_reason(df, checks).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def finite_values(c: Column) -> Column:
    return finite(c)
