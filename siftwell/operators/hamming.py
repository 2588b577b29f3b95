"""Pairs of 64-bit hashes within a Hamming distance, exactly, by an index of parts.

The bits are cut into parts, and each part gets a threshold, such that thresholds plus the number of parts come to more than the distance
searched. Then a pair within that distance has a part that differs by no more than its threshold. For each part the smaller side emits
its value and all within the threshold, the larger one its value alone, and both meet on equal values; a pair is taken in the first part
that brings it together, where it meets once.

How many parts, and which of them get the larger thresholds, is chosen by what it would cost: rows emitted plus pairs met. How often values
of a part meet is measured on samples of both sides, so parts whose bits are skewed get small thresholds. Samples only steer the plan;
whatever they say, the result is the same.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Rows of a side whose values are measured.
SAMPLE = 4000
#: A pair that meets costs less than a row that is emitted and shuffled.
PAIR_COST = 0.2
#: Most values that a row emits for a part.
MOST_VALUES = 4000

Plan = list[tuple[int, int, int]]  # first bit, width and threshold of each part


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def meeting_rate(a: np.ndarray, b: np.ndarray, at: int, width: int) -> float:
    """How likely two rows agree on a part, by samples (unsigned), but no less than for even bits."""
    mask = np.uint64((1 << width) - 1)
    x, n = np.unique(a >> np.uint64(at) & mask, return_counts=True)
    y, m = np.unique(b >> np.uint64(at) & mask, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return max(float((n[i] * m[j]).sum()) / max(len(a) * len(b), 1), 2.0**-width)


def plan_parts(small: int, large: int, distance: int, a: np.ndarray, b: np.ndarray) -> Plan:
    """The cheapest parts and thresholds found for sides of so many rows and samples of their hashes."""
    best: tuple[float, Plan] | None = None
    for count in range(1, min(distance + 1, BITS) + 1):
        cuts = [BITS * i // count for i in range(count + 1)]
        parts = [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]
        rates = [meeting_rate(a, b, *p) for p in parts]

        def cost(i: int, t: int) -> float:
            values = _ball(parts[i][1], t)
            return float("inf") if values > MOST_VALUES else small * values * (1 + PAIR_COST * large * rates[i]) + large

        given = [0] * count
        for _ in range(distance + 1 - count):
            i = min(range(count), key=lambda i: cost(i, given[i] + 1) - cost(i, given[i]))
            given[i] += 1
        total = sum(cost(i, t) for i, t in enumerate(given))
        if best is None or total < best[0]:
            best = (total, [(at, width, t) for (at, width), t in zip(parts, given)])
    if best[0] == float("inf"):  # so far apart that no parts are cheap: as many as there are, which is a search of nearly all pairs
        count = min(distance + 1, BITS)
        return [(BITS * i // count, BITS * (i + 1) // count - BITS * i // count, 0) for i in range(count)]
    return best[1]


def _part(h: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))


def _flips(width: int, radius: int) -> list[int]:
    flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [f - (1 << BITS) if f >= 1 << (BITS - 1) else f for f in flips]


def _sampled(df: DataFrame, n: int) -> np.ndarray:
    rows = df.select("h").sample(min(1.0, SAMPLE / max(n, 1)), seed=1).limit(2 * SAMPLE).toArrow()
    return rows.column("h").to_numpy().astype(np.int64).view(np.uint64)


def hamming_pairs(left: DataFrame, right: DataFrame, max_distance: int = 5) -> DataFrame:
    """(lid, rid, distance) with distance < max_distance between (lid, h) and (rid, h), exactly. A null hash is in no pair; repeated rows
    give a pair each."""
    left, right = (df.select(name, F.col("h").cast("long").alias("h")).where("h IS NOT NULL") for df, name in ((left, "lid"), (right, "rid")))
    n, m = left.count(), right.count()
    if max_distance < 1 or not n or not m:
        pair = left.select("lid").limit(0).crossJoin(right.select("rid").limit(0))
        return pair.withColumn("distance", F.lit(0).cast("bigint"))
    x, y = left.select("lid", F.col("h").alias("lh")), right.select("rid", F.col("h").alias("rh"))
    a, b = _sampled(left, n), _sampled(right, m)
    if n <= m:
        few, many, own, other, plan = x, y, "lh", "rh", plan_parts(n, m, max_distance - 1, a, b)
    else:
        few, many, own, other, plan = y, x, "rh", "lh", plan_parts(m, n, max_distance - 1, b, a)
    differ = F.col("lh").bitwiseXOR(F.col("rh"))

    def emitted(i: int, at: int, width: int, t: int) -> Column:
        values = F.transform(F.array(*[F.lit(f).cast("long") for f in _flips(width, t)]), lambda f: _part(F.col(own), at, width).bitwiseXOR(f))
        return F.transform(values, lambda v: F.struct(F.lit(i).alias("part"), v.alias("value")))

    balls = F.concat(*[emitted(i, *p) for i, p in enumerate(plan)])
    plain = F.array(*[F.struct(F.lit(i).alias("part"), _part(F.col(other), at, width).alias("value")) for i, (at, width, _) in enumerate(plan)])
    met = few.select("*", F.inline(balls)).join(many.select("*", F.inline(plain)), ["part", "value"])
    first = F.lit(len(plan))
    for i, (at, width, t) in reversed(list(enumerate(plan))):
        first = F.when(F.bit_count(_part(differ, at, width)) <= t, i).otherwise(first)
    return met.where((F.bit_count(differ) < max_distance) & (F.col("part") == first)).select("lid", "rid", F.bit_count(differ).cast("bigint").alias("distance"))
