"""From raw corpora to training rows: buckets, mixture, leak check against evaluation sets, nested parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators import filters as P
from siftwell.operators.hamming import hamming_pairs
from siftwell.operators.joins import bounded, name_lookup, with_lookup
from siftwell.operators.nearest import cosine_top1
from siftwell.operators.projections import BUCKETS, row_index, train_rows
from siftwell.operators.sampling import allocate, quota_sampler, shuffled_head, stratified_sample
from siftwell.plans.pluggable import embed, hash_images, tokenize
from siftwell.sources.datasets import eligible_images, load_tally, load_virl
from siftwell.sources.records import keep_image

NEGATIVES = ("random", "popular", "cooccur")


def _manifest(rows: DataFrame, bucket: str, path: Column, **extras: Column) -> DataFrame:
    as_variant = F.parse_json(F.to_json(F.struct(*[c.alias(k) for k, c in extras.items()])))
    return rows.select("sample_id", F.lit(bucket).alias("bucket"), "question", "gold", path.alias("image_path"), as_variant.alias("extras"))


def _under(root: str, path: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), path) if root else path


def virl_bucket(rows: DataFrame, n: int, seed: int, root: str = "") -> DataFrame:
    """n rows over the categories, of those with one image, a boxed answer and a pass rate from 0.3 to 0.9."""
    picked = stratified_sample(load_virl(rows), "category", "sample_id", n, seed)
    return _manifest(picked, "virl39k", _under(root, F.get("image_paths", F.lit(0))), pass_rate_32b=F.col("pass_rate"), category=F.col("category"), source=F.col("source"))


def pope_bucket(categories: DataFrame, annotations: DataFrame, images: DataFrame, eval_ids: DataFrame, n: int, seed: int, root: str = "", weights: dict[str, float] | None = None) -> DataFrame:
    """Half yes and half no questions about images that are no evaluation images; the noes over the kinds of hard negatives."""
    pairs = annotations.select("image_id", F.col("category_id").cast("string").alias("cat")).distinct()
    cats = categories.select(F.col("id").cast("string").alias("cat"), "name")
    sets = eligible_images(pairs, eval_ids, 1)
    n_yes = round(n / 2)
    quotas = allocate(weights or dict.fromkeys(NEGATIVES, 1.0), n - n_yes)
    drawn = name_lookup(quota_sampler(sets, pairs, cats.select("cat"), n_yes, quotas, seed), cats, "category", "cat", "name", "category_name")
    files = images.select(F.col("id").alias("image_id"), "file_name")
    rows = drawn.join(files, "image_id").select(
        F.concat_ws("_", F.lit("pope_style"), F.col("image_id").cast("string"), "gold", "neg_type", "category").alias("sample_id"),
        F.concat(F.lit("Is there a "), "category_name", F.lit(" in the image?")).alias("question"), F.initcap("gold").alias("gold"), "file_name", "neg_type", "image_id", "category", "category_name",
    )
    return _manifest(rows, "pope_style", _under(root, F.col("file_name")), neg_type=F.col("neg_type"), image_id=F.col("image_id"), category_id=F.col("category").try_cast("bigint"), category=F.col("category_name"), source=F.lit("coco_train2017"))


def tally_bucket(rows: DataFrame, eval_ids: DataFrame, n: int, seed: int, root: str = "", hi: int = 50) -> DataFrame:
    """n complex counting questions whose answer is an integer up to hi and whose image is no evaluation image."""
    picked = shuffled_head(load_tally(rows, eval_ids, hi=hi), "sample_id", n, seed)
    return _manifest(picked, "tallyqa", _under(root, F.get("image_paths", F.lit(0))), image_id=F.col("image_id"), source=F.lit("tallyqa"))


def synthetic_bucket(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows of a synthetic manifest as read by read_synth_manifest."""
    return _manifest(shuffled_head(rows, "sample_id", n, seed), "synthetic", F.col("image_path"), topic=F.col("topic"), source=F.col("source"))


def mixture(buckets: dict[str, DataFrame]) -> DataFrame:
    """Manifest rows of all buckets; none at all raises when the mixture is written."""
    out = None
    for name in sorted(buckets):
        out = buckets[name] if out is None else out.unionByName(buckets[name])
    if out is None:
        raise ValueError("no bucket to mix")
    return out


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files, so that listed and stated paths compare."""
    return F.regexp_replace(path, "^file:/*", "/")


def leak_check(
    train: DataFrame,
    evals: DataFrame,
    eval_ids: DataFrame | None = None,
    files: DataFrame | None = None,
    hash_fn: Callable[[bytes], int] | None = None,
    embed_fn: Callable[[list], list] | None = None,
    layers: tuple[str, ...] = ("image_id", "phash", "clip"),
    max_hamming: int = 5,
    threshold: float = 0.95,
) -> DataFrame:
    """FINDING rows of up to three layers over image references, each image once a side.

    image_id: the training image's id is an evaluation id. phash: hashes of the files' bytes differ in fewer than max_hamming bits
    (without hash_fn only equal files meet). clip: the most similar evaluation embedding lies above threshold; the layer needs
    embed_fn, a function from a list of bytes to one of vectors. files is (path, bytes); without it only ids are compared. References
    whose file is missing or can't be hashed are left out. References are identified by 64-bit hashes of their keys.
    """
    known = {"image_id", "phash", "clip"}
    if set(layers) - known:
        raise KeyError(f"{sorted(set(layers) - known)} are none of {sorted(known)}")
    left, right = (keep_image(d).withColumn("ref", F.xxhash64("unique_key")) for d in (train, evals))
    found = []
    if "image_id" in layers and eval_ids is not None:
        ids = bounded(eval_ids.select("image_id").distinct())
        tag = "eval_image_ids"
        hit = left.join(ids, "image_id", "left_semi").withColumns({"distance": F.lit(0.0), "layer": F.lit("image_id")})
        found.append(_finding(hit, F.concat(F.lit(f"{tag}_"), F.col("image_id").cast("string")), F.lit(tag), F.col("image_id"), F.lit(None).cast("string")))
    if files is not None and "phash" in layers:
        hashed = [hash_images(_with_files(d, files), hash_fn).where(~F.col("failed")).select(F.col("path").cast("bigint").alias(i), "h") for d, i in ((left, "lid"), (right, "rid"))]
        found.append(_matched(hamming_pairs(*hashed, max_hamming).withColumn("distance", F.col("distance").cast("double")), "phash", left, right, "lid", "rid"))
    if files is not None and "clip" in layers and embed_fn is not None:
        vectors = [embed(_with_files(d, files), embed_fn, "path", "bytes").select(F.col("path").cast("bigint").alias(i), "v") for d, i in ((left, "tid"), (right, "eid"))]
        near = cosine_top1(*vectors, threshold).withColumn("distance", 1 - F.col("similarity"))
        found.append(_matched(near, "clip", left, right, "tid", "eid"))
    from siftwell.schemas import FINDING

    out = train.sparkSession.createDataFrame([], FINDING)
    for f in found:
        out = out.unionByName(f)
    return out


def _with_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, bytes) where path is the reference's number, as text."""
    side = files.select(plain_path(F.col("path")).alias("__at"), "bytes")
    return refs.where("path IS NOT NULL").join(side, plain_path(F.col("path")) == F.col("__at")).select(F.col("ref").cast("string").alias("path"), "bytes")


def _matched(pairs: DataFrame, layer: str, left: DataFrame, right: DataFrame, lid: str, rid: str) -> DataFrame:
    there = right.select(F.col("ref").alias(rid), F.struct("sample_id", "source_tag", "image_id", "path").alias("e"))
    hit = pairs.join(left.withColumnRenamed("ref", lid), lid).join(there, rid).withColumn("layer", F.lit(layer))
    return _finding(hit, F.col("e.sample_id"), F.col("e.source_tag"), F.col("e.image_id"), F.col("e.path"))


def _finding(hit: DataFrame, eval_sample: Column, eval_source: Column, eval_image: Column, eval_path: Column) -> DataFrame:
    return hit.select(
        "layer", F.col("sample_id").alias("train_sample_id"), F.col("source_tag").alias("train_source"), eval_sample.alias("eval_sample_id"), eval_source.alias("eval_source"), F.col("distance"),
        F.col("image_id").alias("train_image_id"), eval_image.alias("eval_image_id"), F.col("path").alias("train_path"), eval_path.alias("eval_path"),
    )


def manifest_refs(rows: DataFrame) -> DataFrame:
    """IMAGE_REF rows of manifest rows."""
    number = F.try_variant_get("extras", "$.image_id", "bigint")
    return rows.select("sample_id", F.coalesce("image_path", F.concat(F.lit("#"), "sample_id")).alias("unique_key"), F.col("bucket").alias("source_tag"), number.alias("image_id"), F.col("image_path").alias("path"))


def training_table(records: DataFrame, files: DataFrame, lookup: DataFrame | None = None, encode: Callable[[str], list[int]] | None = None, tokenizer: str = "", template: str = "qwen2_5_vl_default", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows of a teacher's records without error, and (reason, n) of what was left out and kept.

    files is (path, bytes). lookup is (sample_id, image_paths) for records that state no image. Rows are numbered by sample_id; limit
    is the first so many of them.
    """
    good = records.where(F.coalesce("error", F.lit("")) == "")
    if lookup is not None:
        own = F.col("bucket") == "virl39k"
        good = with_lookup(good.where(own), lookup, "sample_id", "image_paths", "image_paths").unionByName(good.where(~own | own.isNull()))
    side = files.select(plain_path(F.col("path")).alias("__at"), F.col("bytes").alias("image"))
    rows = good.withColumn("__path", plain_path(F.get("image_paths", F.lit(0)))).join(side, F.col("__path") == F.col("__at"), "left")
    checks = [
        ("unsupported_bucket", F.col("bucket").isin(*BUCKETS)),
        ("missing_image", F.size("image_paths") > 0),
        ("several_images", F.size("image_paths") == 1),
        ("load_error", F.col("image").isNotNull()),
        ("empty_gold", P.non_blank(F.col("gold"))),
    ]
    judged = P.with_reject_reason(rows, checks)
    kept = judged.where("reject_reason IS NULL")
    if limit is not None:
        kept = kept.orderBy("sample_id").limit(limit)
    kept = row_index(kept.drop("extras", "reject_reason", "__path", "__at"), "sample_id")
    if encode is not None:
        kept = tokenize(kept.withColumn("__response", X.gold_response(X.strip(F.col("gold")))), "__response", encode, "gold_token_ids")
    counts = judged.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return train_rows(kept, tokenizer, template), counts
