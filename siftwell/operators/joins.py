"""Joins between predictions, and between training and evaluation sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.windows import keep_last

BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast where it has at most so many rows, which is checked; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def teacher_student(teacher: DataFrame, student: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Inner by key; of a repeated student key the last counts. Student columns get the prefix s_."""
    last = keep_last(student, [key], order)
    return teacher.join(last.select(key, *[F.col(c).alias(f"s_{c}") for c in last.columns if c != key]), key)


def three_way(teacher: DataFrame, after: DataFrame, base: DataFrame | None, key: str, order: Sequence[str]) -> DataFrame:
    """Teacher rows with their student row, and the base model's row where there is one."""
    out = teacher_student(teacher, after, key, order)
    if base is None:
        return out.withColumn("b_answer", F.lit(None).cast("string")).withColumn("b_correct", F.lit(None).cast("boolean"))
    last = keep_last(base, [key], order)
    return out.join(last.select(key, *[F.col(c).alias(f"b_{c}") for c in last.columns if c != key]), key, "left")


def seen_ids(train: DataFrame, eval_ids: DataFrame, key: str = "image_id") -> DataFrame:
    """Training rows whose id is an evaluation id; a null id never is."""
    return train.join(bounded(eval_ids.select(key).distinct()), key, "left_semi")


def unseen_ids(rows: DataFrame, eval_ids: DataFrame, key: str = "image_id") -> DataFrame:
    return rows.join(bounded(eval_ids.select(key).distinct()), key, "left_anti")


def drop_seen_if(rows: DataFrame, eval_ids: DataFrame, condition: Column, key: str = "image_id") -> DataFrame:
    """Rows that don't both meet the condition and have an evaluation id."""
    ids = bounded(eval_ids.select(F.col(key).alias("__id")).distinct())
    return rows.join(ids, (F.col(key) == F.col("__id")) & condition, "left_anti")


def containing(rows: DataFrame, items: DataFrame, text: str, item: str, words: int = 4) -> DataFrame:
    """Pairs of rows and items whose item is within the text, as an equi-join: both meet on a run of inner words of the item, which any
    text that holds it must hold, too. Items of few words, which have no such run, are compared with every text behind a check of
    their number."""

    def split(of: str) -> Column:
        return F.split(F.col(of), r"\s+")

    def run(of: Column, i: Column | int) -> Column:
        return F.xxhash64(*[F.get(of, F.lit(i) + k if isinstance(i, int) else i + k) for k in range(words)])

    cut = items.withColumn("__w", split(item))  # a text may go on within the item's first and last words, so these don't count
    long_ = cut.where(F.size("__w") >= words + 2).withColumn("__key", run(F.col("__w"), 1)).drop("__w")
    few = bounded(cut.where(F.size("__w") < words + 2).drop("__w"), 10_000)
    hashed = rows.withColumn("__w", split(text))
    starts = F.when(F.size("__w") >= words, F.sequence(F.lit(0), F.size("__w") - words))
    keys = F.array_distinct(F.transform(starts, lambda i: run(F.col("__w"), i)))
    met = hashed.withColumn("__key", F.explode(keys)).drop("__w").join(bounded(long_), "__key").where(F.contains(text, item)).drop("__key")
    return met.unionByName(rows.join(few, F.contains(text, item)))


def with_lookup(rows: DataFrame, lookup: DataFrame, key: str, inline: str, found: str) -> DataFrame:
    """inline, or where it is null or empty the lookup's value; the join is skipped when no row needs it."""
    missing = F.col(inline).isNull() | (F.size(inline) == 0)
    if not rows.where(missing).limit(1).count():
        return rows
    side = lookup.select(key, F.col(found).alias("__found"))
    return rows.join(side, key, "left").withColumn(inline, F.when(missing, F.col("__found")).otherwise(F.col(inline))).drop("__found")


def name_lookup(rows: DataFrame, names: DataFrame, key: str, id_col: str, name_col: str, alias: str) -> DataFrame:
    side = bounded(names.select(F.col(id_col).alias(key), F.col(name_col).alias(alias)))
    return rows.join(side, key, "left")


def cooccurrence(pairs: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): in how many groups two different items stand together, both ways round.

    Each group is one sorted array of distinct items, as wide as one image or order has items; nothing is joined to itself.
    """
    sets = pairs.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group).agg(F.collect_set(item).alias("items"))
    both = sets.select(F.explode("items").alias("a"), "items").select("a", F.explode("items").alias("b"))
    return both.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def with_bytes(rows: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows with their file's bytes; load_error where there is no such file."""
    return rows.join(files.select(F.col("path").alias(path), "bytes"), path, "left").withColumn("load_error", F.col("bytes").isNull())


def overlap_of(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on both sides, which a split expects to be none."""
    return left.select(key).intersect(right.select(key))


def leak_findings(hits: DataFrame, layer: str, train_id: str, eval_id: str, distance: Column) -> DataFrame:
    """FINDING rows of one layer."""
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    return hits.select(
        F.lit(layer).alias("layer"),
        F.col(train_id).cast("string").alias("train_sample_id"),
        F.lit("train").alias("train_source"),
        F.col(eval_id).cast("string").alias("eval_sample_id"),
        F.lit("eval").alias("eval_source"),
        distance.cast("double").alias("distance"),
        none.alias("train_image_id"),
        none.alias("eval_image_id"),
        text.alias("train_path"),
        text.alias("eval_path"),
    )
