"""Scans of JSON lines, logs, parquet, Arrow files, binary files and manifests into DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.schemas import COCO, MIXTURE, SYNTHETIC
from siftwell.sources.arrow_files import read_arrow  # noqa: F401
from siftwell.sources.json_arrays import JsonDocument, document_kind
from siftwell.sources.storage import by_ranges, file_sizes


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines; blank lines give no row, NaN is a number."""
    return spark.read.schema(schema).json(paths if isinstance(paths, str) else list(paths))


def load_records(spark: SparkSession, paths: str | Sequence[str], schema: str, error_mode: str = "present") -> DataFrame:
    """Records without error rows: those whose error is set ('present'), or set and not empty ('truthy'). A missing path raises."""
    if error_mode not in ("present", "truthy"):
        raise ValueError(f"unknown error mode {error_mode}")
    error = F.col("error")
    return read_jsonl(spark, paths, schema).where(error.isNull() if error_mode == "present" else F.coalesce(error, F.lit("")) == "").drop("error")


def count_by_file(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """(path, total, errors) for each file."""
    rows = read_jsonl(spark, paths, schema).select(F.col("_metadata.file_path").alias("path"), "error")
    return rows.groupBy("path").agg(F.count("*").alias("total"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(s.getPath()) for s in found or [])


def shard_paths(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """prefix.shard*.jsonl in a folder, else prefix.jsonl; only names pass through the driver."""
    return _glob(spark, f"{folder}/{prefix}.shard*.jsonl") or _glob(spark, f"{folder}/{prefix}.jsonl")


def glob_pair(spark: SparkSession, folder: str, teacher: str, student: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return tuple(load_records(spark, _glob(spark, f"{folder}/{g}"), schema) for g in (teacher, student))


def read_json_any(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of JSON lines (.jsonl), of one top-level list, or of {"data": [...]}; anything else raises. Lists are read by many tasks."""
    if path.rstrip("/").endswith(".jsonl"):
        return read_jsonl(spark, path, row)
    first = file_sizes(spark, path).where("length > 0").first()
    if first and by_ranges(first.path):
        kind = document_kind(first.path)
        if kind in "[{":
            doc = JsonDocument(spark, path)
            if kind == "[" or "data" in doc.keys():
                return doc.rows("" if kind == "[" else "data", row)
    elif first:
        return _read_whole_json(spark, path, row)
    raise ValueError(f"{path} holds neither lines, a list nor data")


def _read_whole_json(spark: SparkSession, path: str, row: str) -> DataFrame:
    """The same for a store that only Spark reads: a document a task."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if head and head.c == "[":
        return spark.read.schema(row).json(path, multiLine=True)
    if head and head.c == "{":
        nested = spark.read.schema(f"data array<struct<{','.join(p.strip().replace(' ', ':', 1) for p in _fields(row))}>>").json(path, multiLine=True)
        if nested.where("data IS NOT NULL").limit(1).count():
            return nested.select(F.explode("data").alias("d")).select("d.*")
    raise ValueError(f"{path} holds neither lines, a list nor data")


def _fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, annotations, images) of an instances file, each read by as many tasks as it has ranges."""
    kinds = {f.name: f.dataType.elementType.simpleString() for f in spark.createDataFrame([], COCO).schema}
    first = file_sizes(spark, path).where("length > 0").first()
    if first and not by_ranges(first.path):
        whole = spark.read.schema(COCO).json(path, multiLine=True)
        return tuple(whole.select(F.explode(c).alias("x")).select("x.*") for c in ("categories", "annotations", "images"))
    doc = JsonDocument(spark, path)
    return tuple(doc.rows(c, kinds[c]) for c in ("categories", "annotations", "images"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("bytes"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line); bytes that are no UTF-8 become replacement characters."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_synth_manifest(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Synthetic manifest rows; topic and source stand in extras where they were missing, paths are joined to the folder."""
    rows = read_jsonl(spark, path, SYNTHETIC)
    own = F.try_variant_get("extras", "$.topic", "string")
    source = F.try_variant_get("extras", "$.source", "string")
    return rows.select("sample_id", "question", "gold", F.concat_ws("/", F.lit(folder), "image_path").alias("image_path"), F.coalesce(own, "topic").alias("topic"), F.coalesce(source, F.lit("synthetic")).alias("source"))


def read_mixture(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, MIXTURE)


def read_metric_rows(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Metric rows of each named configuration, with its name; configurations without a file are left out."""
    out = None
    for name, path in sorted(paths.items()):
        if _glob(spark, path):
            rows = spark.read.schema(schema).json(path).select(F.lit(name).alias("config"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"config string, {schema}")


def first_ids(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """(image_id): distinct ids of the first candidate column that gives any; none if no column does."""
    for c in candidates:
        if c in df.columns:
            ids = df.select(X.image_id(F.col(c).cast("string")).alias("image_id")).where("image_id IS NOT NULL").distinct()
            if ids.limit(1).count():
                return ids
    return df.sparkSession.createDataFrame([], "image_id bigint")


def image_refs(df: DataFrame, tag: str, sample_id: Column, image_id: Column | None = None, path: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    """IMAGE_REF rows. unique_key is the path, else the image id, else the tag with a stated ordinal."""
    image_id = F.lit(None).cast("bigint") if image_id is None else image_id
    path = F.lit(None).cast("string") if path is None else path
    fallback = F.concat(F.lit(f"{tag}#"), (sample_id if ordinal is None else ordinal).cast("string"))
    key = F.coalesce(path, F.concat(F.lit("id:"), image_id.cast("string")), fallback)
    return df.select(sample_id.alias("sample_id"), key.alias("unique_key"), F.lit(tag).alias("source_tag"), image_id.alias("image_id"), path.alias("path"))


def keep_image(ref: DataFrame) -> DataFrame:
    """The first reference of each unique key."""
    from siftwell.operators.windows import keep_first

    return keep_first(ref, ["unique_key"], ["sample_id", "source_tag"])


class Registry:
    """Named builders of DataFrames; an unknown name raises with the known ones."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str) -> Callable:
        def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.known[name] = f
            return f

        return put

    def load(self, name: str, *args, **kwargs) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"{name} is none of {sorted(self.known)}")
        return self.known[name](*args, **kwargs)


def sample_pope(rows: DataFrame, n: int | None = None) -> DataFrame:
    """(sample_id, question, gold, extras map): an empty or zero id falls back to question_id, answers are stripped and lowered."""
    own = F.when(F.coalesce(F.col("id").cast("string"), F.lit("")).isin("", "0"), F.col("question_id").cast("string")).otherwise(F.col("id").cast("string"))
    out = rows.select(own.alias("sample_id"), "question", X.canonical(F.col("answer")).alias("gold"), F.col("image_source").alias("image_source"), F.coalesce("category", F.lit("adversarial")).alias("category"))
    return out if n is None else out.orderBy("sample_id").limit(n)


def sample_mathvista(rows: DataFrame) -> DataFrame:
    """metadata is JSON text; what doesn't parse counts as {}."""
    meta = F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}")))
    return rows.select(F.col("pid").alias("sample_id"), "question", F.col("answer").alias("gold"), F.try_variant_get(meta, "$.task", "string").alias("task"), F.try_variant_get(meta, "$.source", "string").alias("source"))


def sample_vlmbias(rows: DataFrame, subset: str, known: Sequence[str] = ("main", "identification", "withtitle")) -> DataFrame:
    if subset not in known:
        raise KeyError(f"{subset} is none of {sorted(known)}")
    return rows.select(F.lit(f"vlmbias_{subset}").alias("dataset"), F.col("ID").alias("sample_id"), F.col("prompt").alias("question"), F.col("ground_truth").alias("gold"), "expected_bias", "topic")
