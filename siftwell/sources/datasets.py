"""Loaders of the training buckets: each filters its raw rows in a stated order and can account for what it rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators import filters as P
from siftwell.operators.joins import bounded

# Names under which COCO images are filed.
COCO_SOURCES = ("imageqa", "vqa", "coco", "mscoco", "coco2014", "coco2017")


def virl_checks(lo: float | None, hi: float | None, single_image_only: bool = True, require_boxed: bool = True) -> list[tuple[str, Column]]:
    checks = [("image_count", P.single(F.col("image")))] if single_image_only else []
    checks.append(("pass_rate", P.in_range(F.col("PassRate_32BTrained"), lo, hi)))
    return [*checks, ("no_box", X.has_boxed(F.col("answer")))] if require_boxed else checks


def load_virl(rows: DataFrame, lo: float | None = 0.3, hi: float | None = 0.9, single_image_only: bool = True, require_boxed: bool = True) -> DataFrame:
    """(sample_id, question, image_paths, gold, category, source, pass_rate). Bounds are inclusive; rows with an empty box stay, with
    an empty gold. The plain range comes first as a filter of its own, so that it reaches the parquet scan."""
    kept = rows.where(P.in_range(F.col("PassRate_32BTrained"), lo, hi))
    for _, ok in virl_checks(lo, hi, single_image_only, require_boxed):
        kept = kept.where(ok)
    return kept.select(F.col("qid").alias("sample_id"), X.strip_placeholders(F.col("question")).alias("question"), F.col("image").alias("image_paths"), X.boxed(F.col("answer")).alias("gold"), "category", "source", F.col("PassRate_32BTrained").alias("pass_rate"))


def tally_checks(eval_ids: DataFrame | None, lo: int = 0, hi: int = 15) -> list[tuple[str, Column]]:
    """In code order: complex, has an image, not a leaked COCO image (column leaked), answer in range."""
    leaked = [] if eval_ids is None else [("leaked", ~F.coalesce("leaked", F.lit(False)))]
    return [("simple", P.not_simple(F.col("issimple"))), ("no_image", P.non_empty(F.col("image"))), *leaked, ("answer", P.integer_in(F.col("answer"), lo, hi))]


def mark_leaked(rows: DataFrame, eval_ids: DataFrame) -> DataFrame:
    """leaked: a COCO-sourced row whose image is an evaluation image."""
    ids = bounded(eval_ids.select(F.col("image_id").alias("__id")).distinct().withColumn("__seen", F.lit(True)))
    coco = P.source_in(F.coalesce("data_source", "source"), COCO_SOURCES)
    return rows.join(ids, F.col("image_id") == F.col("__id"), "left").withColumn("leaked", coco & F.coalesce("__seen", F.lit(False))).drop("__id", "__seen")


def load_tally(rows: DataFrame, eval_ids: DataFrame, lo: int = 0, hi: int = 15) -> DataFrame:
    marked = mark_leaked(rows, eval_ids)
    for _, ok in tally_checks(eval_ids, lo, hi):
        marked = marked.where(ok)
    ids = X.joined_id(F.lit("tally"), F.col("image_id").cast("string"), F.col("question_id").cast("string"))
    return marked.select(ids.alias("sample_id"), "question", F.array("image").alias("image_paths"), F.col("answer").alias("gold"), "image_id")


def eligible_images(annotations: DataFrame, eval_ids: DataFrame, least: int = 3) -> DataFrame:
    """(image_id, cats) of images with enough distinct categories that are no evaluation images."""
    from siftwell.operators.joins import unseen_ids

    sets = annotations.groupBy("image_id").agg(F.sort_array(F.collect_set("cat")).alias("cats")).where(P.at_least(F.col("cats"), least))
    return unseen_ids(sets, eval_ids)
