"""Aggregates with the engine's null rules: null on empty input and zero denominators, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import kept

def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_mean(c: Column) -> Column:
    return F.avg(F.when(finite(c), c))


def rate(c: Column) -> Column:
    """Share of true among non-null."""
    return F.avg(c.cast("int"))


def percentile(c: Column, p: float) -> Column:
    """Linear interpolation, p from 0 to 100, nulls left out."""
    return F.percentile(c, p / 100)


#: A group of up to so many values gets its percentiles from one aggregate; a larger one from ranges.
GROUP_ROWS = 1_000_000


def percentiles(df: DataFrame, value: str, by: list[str], ps: dict[str, float], group_rows: int = GROUP_ROWS) -> DataFrame:
    """(by..., a column for each of ps): exact percentiles of each group, by linear interpolation, p from 0 to 100, nulls left out. A
    group without values has no row. Null keys are a group.

    The built-in aggregate holds a group's distinct values in one task, so it only gets groups of a checked size. Larger ones are cut
    into ranges by approximate quantiles of their own and counted by range; then only the ranges that hold a wanted place are sorted.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    large = kept(known.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > group_rows), "large-groups")
    whole = lambda d: d.groupBy(*by).agg(*[F.percentile("__v", p / 100).alias(name) for name, p in ps.items()])
    if large.isEmpty():
        return whole(known)
    return whole(_paired(known, large, by, "left_anti")).unionByName(_by_ranges(_paired(known, large, by, "inner"), by, ps))


def _paired(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by keys in which nulls are equal."""
    side = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(side, same, how).drop(*[f"__{k}" for k in keys])


def _by_ranges(rows: DataFrame, by: list[str], ps: dict[str, float]) -> DataFrame:
    """percentiles of rows (by..., __v, __n: the group's size)."""
    n = max(2, min(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.groupBy(*by).agg(F.percentile_approx("__v", [i / n for i in range(1, n)], 4 * RANGES).alias("__cuts"))
    placed = _paired(rows, cuts, by, "inner").withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    counts = placed.groupBy(*by, "__range").agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    start = F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = F.array(*[F.struct(F.lit(name).alias("__p"), (F.lit(p / 100) * (F.col("__n") - 1)).alias("__at")) for name, p in ps.items()])
    asked = counts.withColumn("__start", start).select(*by, "__range", "__c", "__start", F.inline(places))
    ends = F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))
    wanted = asked.select(*by, "__range", "__start", "__c", "__p", "__at", F.explode(ends).alias("__k")).where((F.col("__k") >= F.col("__start")) & (F.col("__k") < F.col("__start") + F.col("__c"))).drop("__c")
    keys = [*by, "__range"]
    values = _paired(placed, wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = _paired(values.withColumn("__before", before), wanted, keys, "inner")
    inside = F.col("__k") - F.col("__start") - F.col("__before")
    ends_of = found.where((inside >= 0) & (inside < F.col("__c"))).groupBy(*by, "__p").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.first("__at").alias("__at"))
    value = F.col("__lo") + F.when(F.col("__hi") == F.col("__lo"), 0.0).otherwise((F.col("__hi") - F.col("__lo")) * (F.col("__at") - F.floor("__at")))
    return ends_of.groupBy(*by).agg(*[F.max(F.when(F.col("__p") == name, value)).alias(name) for name in ps])


def clamp0(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def chance(k: Column) -> Column:
    """1 / (k - 1) for an answer space of two or more."""
    return F.when(k >= 2, F.lit(1.0) / (k - 1))


RANGES = 256


def range_cuts(df: DataFrame, *values: str) -> list[list[float]]:
    """For each column values that cut its rows into about equal ranges, one for each shuffle partition and RANGES at most."""
    n = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n < 2:
        return [[] for _ in values]
    shares = [i / n for i in range(1, n)]
    return [sorted(set(c or [])) for c in df.agg(*[F.percentile_approx(F.col(v).cast("double"), shares, 4 * RANGES).alias(f"c{i}") for i, v in enumerate(values)]).first()]


def average_ranks(df: DataFrame, value: str, by: list[str], cuts: list[float] | None = None) -> DataFrame:
    """(by..., value, rank): the average rank from 1 of each distinct value of a group, nulls left out; value becomes a double.

    Values are counted first, so that ties are one row. Groups are cut into ranges (range_cuts if none are given, one small job), and
    a range's rows are numbered by themselves, after the counts of the ranges before it: no task sorts a whole group.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value))
    edges = F.array(*[F.lit(c) for c in (range_cuts(known, value)[0] if cuts is None else cuts)]).cast("array<double>")
    cell = known.groupBy(*by, value).agg(F.count("*").alias("__n")).withColumn("__range", F.size(F.filter(edges, lambda e: e < F.col(value))))
    keys = [*by, "__range"]
    within = cell.withColumn("__before", _sum_before(Window.partitionBy(*keys).orderBy(value)))
    sizes = cell.groupBy(*keys).agg(F.sum("__n").alias("__n")).withColumn("__start", _sum_before(Window.partitionBy(*by).orderBy("__range")))
    starts = sizes.select(*[F.col(k).alias(f"{k}__") for k in keys], "__start")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    rank = F.col("__start") + F.col("__before") + (F.col("__n") + 1) / 2
    return within.join(starts, same).select(*by, value, rank.alias("rank"))


def _sum_before(w) -> Column:
    return F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def with_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """df with the average rank of its value in its group; rows without a value are left out. Adaptive execution broadcasts the ranks
    of few distinct values, and splits hot ones."""
    return _placed(df, average_ranks(df, value, by), value, by, name)


def _placed(df: DataFrame, ranks: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    side = ranks.select(*[F.col(c).alias(f"__{c}") for c in (*by, value)], F.col("rank").alias(name))
    same = F.col(value).cast("double") == F.col(f"__{value}")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(side, same).drop(*[f"__{c}" for c in (*by, value)])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., n, rho) with average ranks for ties; null below three pairs or without variance. Pairs with a null are left out.

    Ranks come from average_ranks, so that no task sorts a whole group.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = known.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cuts = range_cuts(pairs, "x", "y")
    ranked = _placed(_placed(pairs, average_ranks(pairs, "x", by, cuts[0]), "x", by, "rx"), average_ranks(pairs, "y", by, cuts[1]), "y", by, "ry")
    n = F.count("*")
    sx, sy, sxy, sxx, syy = F.sum("rx"), F.sum("ry"), F.sum(F.col("rx") * F.col("ry")), F.sum(F.col("rx") ** 2), F.sum(F.col("ry") ** 2)
    out = ranked.groupBy(*by).agg(n.alias("n"), (n * sxy - sx * sy).alias("cov"), ((n * sxx - sx**2) * (n * syy - sy**2)).alias("var"))
    return out.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("var") > 0), F.try_divide("cov", F.sqrt("var"))).alias("rho"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin from 1, n, density) over equal widths; the last bin holds its upper edge, values outside are left out."""
    inside = df.where(F.col(value).between(lo, hi)).select(F.least(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).alias("bin"))
    counts = inside.groupBy("bin").agg(F.count("*").alias("n"))
    all_n = counts.agg(F.sum("n").alias("all"))  # one row
    return counts.join(F.broadcast(all_n)).select(F.col("bin").cast("bigint").alias("bin"), "n", (F.col("n") / (F.col("all") * ((hi - lo) / bins))).alias("density"))


def confusion(pred: Column, gold: Column) -> dict[str, Column]:
    """Aggregates of a yes/no prediction; null on zero denominators, F1 also where precision + recall is 0."""
    tp, fp = F.count_if(pred & gold), F.count_if(pred & ~gold)
    fn, tn = F.count_if(~pred & gold), F.count_if(~pred & ~gold)
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {
        "tp": tp,
        "fp": fp,
        "fn": fn,
        "tn": tn,
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "precision": p,
        "recall": r,
        "f1": F.try_divide(2 * p * r, p + r),
        "yes_rate": F.try_divide(tp + fp, tp + fp + fn + tn),
    }
