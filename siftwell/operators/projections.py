"""Row construction: samples, manifest rows, nested training rows, flattened metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import text as X


def to_sample(df: DataFrame, **columns: Column) -> DataFrame:
    """(sample_id, question, gold, extras...): source columns renamed into the common sample."""
    need = {"sample_id", "question", "gold"} - set(columns)
    if need:
        raise ValueError(f"a sample needs {sorted(need)}")
    return df.select(*[c.alias(name) for name, c in columns.items()])


def to_manifest(samples: DataFrame, bucket: Column) -> DataFrame:
    """Manifest rows of samples with exactly one image; any other number raises when the row is read."""
    one = F.assert_true(F.size(F.coalesce("image_paths", F.array().cast("array<string>"))) == 1, F.lit("a manifest row needs one image"))
    return samples.select("sample_id", bucket.alias("bucket"), "question", "gold", F.coalesce(one.cast("string"), F.get("image_paths", F.lit(0))).alias("image_path"))


def bucket_of(own: Column, default: Column | str) -> Column:
    return F.coalesce(own, F.lit(default) if isinstance(default, str) else default)


def row_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Running number from 0 over a pinned order, without sorting all rows in one task: sorted ranges are numbered each, and only
    their sizes, one row a range, meet in one place. The ranges are written once, as drawing them again could cut them elsewhere."""
    from siftwell.session import scratch

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    path = scratch(spark, "ranges")
    parts.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1).write.parquet(path)
    local = spark.read.parquet(path)
    sizes = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))
    return local.join(starts, "__part").withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


# The training format.
ABILITY = "vl_distill"
ANSWER_FORMAT = "final_answer_boxed_v1"
BUCKETS = ("virl39k", "pope_style", "tallyqa", "synthetic")


def train_rows(df: DataFrame, tokenizer: str = "", template: str = "qwen2_5_vl_default") -> DataFrame:
    """Nested training rows of (bucket, sample_id, question, gold, image bytes, category, source, trajectory_pass, correct_I).

    pass_rate_32b, gold_token_ids and index come along where df has them (0, none and null else); a null verdict counts as failed.
    """
    gold = X.strip(F.col("gold"))
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("<image>\n"), "question").alias("content")))
    own = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    ids = F.coalesce(own("gold_token_ids", "array<int>"), F.array().cast("array<int>"))
    info = {"index": own("index", "bigint"), "answer": gold, "question": F.col("question"), "tokenizer_name": F.lit(tokenizer), "chat_template_version": F.lit(template), "answer_format": F.lit(ANSWER_FORMAT)}
    return df.select(
        F.concat(F.lit("e1_"), "bucket").alias("data_source"),
        prompt.alias("prompt"),
        F.array(F.struct(F.col("image").alias("bytes"))).alias("images"),
        F.lit(ABILITY).alias("ability"),
        "bucket",
        F.coalesce("trajectory_pass", "correct_I", F.lit(False)).alias("trajectory_pass"),
        gold.alias("gold_text"),
        X.gold_response(gold).alias("gold_response_text"),
        ids.alias("gold_token_ids"),
        F.size(ids).cast("bigint").alias("gold_token_len"),
        "sample_id",
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(own("pass_rate_32b", "double"), F.lit(0.0)).alias("pass_rate_32b"),
        F.struct(F.lit("rule").alias("style"), gold.alias("ground_truth")).alias("reward_model"),
        F.struct(*[c.alias(k) for k, c in info.items()]).alias("extra_info"),
    )


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct columns as one column a leaf, named by their path."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = (*path, f.name)
            out += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))]
        return out

    return df.select(*leaves(df.schema, ()))


def options_for(dataset: Column, gold: Column, expected_bias: Column) -> Column:
    """Option texts to score: yes and no, or the truth and the bias; an empty map elsewhere."""
    empty = F.create_map().cast("map<string,string>")
    return (
        F.when(dataset.startswith("pope"), F.create_map(F.lit("yes"), F.lit("Yes"), F.lit("no"), F.lit("No")))
        .when(dataset.startswith("vlmbias"), F.create_map(F.lit("ground_truth"), gold, F.lit("expected_bias"), expected_bias))
        .otherwise(empty)
    )
