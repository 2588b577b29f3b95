"""Set operations on DataFrames and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat_all(*frames: DataFrame) -> DataFrame:
    """Bag union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def id_union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), frames).distinct()


def id_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: Column, b: Column) -> Column:
    """What of array a is not in b, in a's order, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def key_union(p: Column, q: Column) -> Column:
    return F.array_union(F.map_keys(p), F.map_keys(q))
