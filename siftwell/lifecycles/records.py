"""Diagnostic records with the columns all metrics read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import arrays as A
from siftwell.functions import text as X
from siftwell.plans.pluggable import map_distinct
from siftwell.schemas import DIAGNOSTIC

#: Columns that order records as they stand in their files.
FILE_ORDER = ("file", "block", "nth")

# The groups of datasets.
BIAS, YES_NO, MATH = "vlmbias", "pope", "mathvista"
RECOGNITION = ("Animals", "Chess Pieces", "Flags", "Game Boards", "Logos", "Patterned Grid")


def extra(key: str, kind: str = "string") -> Column:
    return F.try_variant_get("extras", f"$.{key}", kind)


def scan(spark: SparkSession, paths: str | Sequence[str], error_mode: str = "present") -> DataFrame:
    """Records without error rows, prepared. No path gives no record."""
    if not paths:
        rows = spark.createDataFrame([], DIAGNOSTIC.replace("extras variant", "extras string")).withColumn("extras", F.try_parse_json("extras"))
        return prepared(rows.withColumns({"file": F.lit(""), "block": F.lit(0), "nth": F.lit(0)}))
    if error_mode not in ("present", "truthy"):
        raise ValueError(f"unknown error mode {error_mode}")
    rows = spark.read.schema(DIAGNOSTIC).json(paths if isinstance(paths, str) else list(paths))
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    error = F.col("error")
    return prepared(rows.where(error.isNull() if error_mode == "present" else F.coalesce(error, F.lit("")) == ""))


def prepared(records: DataFrame) -> DataFrame:
    """dataset, sample_id, group, topic, gold, text, answer, correct, correct_null, mean_delta, tokens, deltas, opt_i, opt_null and
    what extras hold of choices. A null verdict counts as wrong, an empty series has no mean."""
    text = F.coalesce("ans_T_I", F.lit(""))
    dataset = F.coalesce("dataset", F.lit(""))
    group = F.when(dataset.startswith(BIAS), BIAS).when(dataset == "pope_adversarial", YES_NO).when(dataset == "mathvista_mini", MATH)
    side = lambda k: F.try_element_at("option_logP", F.lit(k))
    return records.select(
        "dataset", "sample_id", group.alias("group"), extra("topic").alias("topic"), "gold", text.alias("text"), X.answer(F.col("dataset"), F.col("ans_T_I")).alias("answer"),
        F.coalesce("correct_I", F.lit(False)).alias("correct"), F.coalesce("correct_null", F.lit(False)).alias("correct_null"), A.mean(F.col("delta_t")).alias("mean_delta"),
        F.col("response_tokens").alias("tokens"), F.col("delta_t").alias("deltas"), side("I").alias("opt_i"), side("null").alias("opt_null"),
        F.coalesce(F.nullif("gold", F.lit("")), extra("ground_truth")).alias("gt_text"), extra("expected_bias").alias("bias_text"),
        extra("question_type").alias("question_type"), extra("choices", "array<string>").alias("choices"), "extras", *FILE_ORDER,
    )


def with_lengths(records: DataFrame, count: Callable[[str], int] | None) -> DataFrame:
    """n_gt_tokens and n_bias_tokens, counted once for each distinct text; null where there is no text or no token."""
    if count is None:
        return records.withColumns({"n_gt_tokens": F.lit(None).cast("bigint"), "n_bias_tokens": F.lit(None).cast("bigint")})
    out = records
    for text, name in (("gt_text", "n_gt_tokens"), ("bias_text", "n_bias_tokens")):
        out = map_distinct(out, text, count, name).withColumn(name, F.when((F.col(name) > 0) & (F.col(text) != ""), F.col(name)))
    return out


def token_counter(path: str) -> Callable[[str], int]:
    """Tokens a text adds after a line break, by a tokenizer file of the tokenizers library."""

    def count(text: str) -> int:
        from tokenizers import Tokenizer

        loaded = _loaded.get(path) or _loaded.setdefault(path, Tokenizer.from_file(path))
        size = lambda s: len(loaded.encode(s, add_special_tokens=False).ids)
        return size("\n" + text) - size("\n")

    return count


_loaded: dict = {}
