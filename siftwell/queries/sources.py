"""Queries of scans and sinks: fixtures are written to the shared scratch folder and read back by the operator."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import stats as S
from siftwell.functions import text as X
from siftwell.lifecycles import evaluation
from siftwell.operators import sets
from siftwell.plans.config import settings_of_files
from siftwell.queries.base import LOG, REC, SERIES, query, run
from siftwell.session import scratch
from siftwell.sources import datasets as D
from siftwell.sources import records as R
from siftwell.sources import sinks as K
from siftwell.sources.appends import append_jsonl, read_appended
from siftwell.streaming.logs import last_by_step, log_series

RECORD = "sample_id string, dataset string, topic string, n_chars bigint, mean_delta double, error string"
VIRL_SQL = """
SELECT CAST(doc_id AS STRING) AS qid, '<image> what is ' || CAST(doc_id AS STRING) AS question, lang AS category, source,
  (doc_id % 100) / 100.0E0 AS PassRate_32BTrained, doc_id % 3 AS n_images, doc_id % 4 AS kind FROM documents
"""
TALLY_SQL = """
SELECT CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'img.jpg' END AS image, doc_id AS image_id, 'how many' AS question,
  CASE WHEN doc_id % 6 <> 0 THEN doc_id + 1 END AS question_id, CASE WHEN doc_id % 9 = 0 THEN 'many' ELSE CAST(doc_id % 20 AS STRING) END AS answer,
  CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 = 0 END AS issimple, CASE WHEN doc_id % 3 = 0 THEN 'COCO2014' ELSE 'vg' END AS data_source, source FROM documents
"""


def _jsonl(df: DataFrame, label: str, name: str = "") -> str:
    path = scratch(df.sparkSession, label) + name
    return K.write_jsonl(df, path)


def _rec(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, REC)


_PLAIN = "sample_id, dataset, topic, n_chars, mean_delta"


@query("SRC01", f"SELECT {_PLAIN} FROM rec", rec=REC)
def src01(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "src01")
    rows = _rec(spark, sf).select("sample_id", "dataset", "topic", "n_chars", "mean_delta")
    rows.select(F.concat(F.to_json(F.struct("*")), F.lit("\n"))).write.text(path)  # a blank line after each row
    return R.read_jsonl(spark, path, RECORD).drop("error")


@query("SRC02", f"SELECT {_PLAIN} FROM rec WHERE error IS NULL", rec=REC)
def src02(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf).select("sample_id", "dataset", "topic", "n_chars", "mean_delta", "error")
    paths = [_jsonl(rows.where(F.col("n_chars") % 2 == k), "src02") for k in (0, 1)]
    return R.load_records(spark, paths, RECORD)


@query("SRC03", f"SELECT {_PLAIN} FROM rec WHERE coalesce(error, '') = ''", rec=REC)
def src03(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf).select("sample_id", "dataset", "topic", "n_chars", "mean_delta", "error")
    return R.load_records(spark, [_jsonl(rows, "src03")], RECORD, "truthy")


@query("SRC04", "SELECT topic, count(*) AS n FROM rec WHERE coalesce(error, '') = '' GROUP BY topic", rec=REC)
def src04(spark: SparkSession, sf: str) -> DataFrame:
    path = _jsonl(_rec(spark, sf).select("sample_id", "topic", "error"), "src04")
    return R.load_records(spark, path, RECORD, "truthy").groupBy("topic").agg(F.count("*").alias("n"))


@query("SRC05", "SELECT topic AS part, count(*) AS total, count(*) FILTER (coalesce(error, '') <> '') AS errors FROM rec GROUP BY topic", rec=REC)
def src05(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "src05")
    K.write_jsonl(_rec(spark, sf).select("sample_id", "topic", "error"), path, by="topic")
    files = R.count_by_file(spark, path, "sample_id string, error string")
    return files.groupBy(F.regexp_extract("path", "topic=([^/]*)", 1).alias("part")).agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))


@query("SRC06", "SELECT CAST(doc_id % 2 AS STRING) AS shard, count(*) AS n FROM rec GROUP BY ALL", rec=REC)
def src06(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "src06")
    for k in (0, 1):
        K.write_jsonl(_rec(spark, sf).where(F.col("doc_id") % 2 == k).select("sample_id"), f"{folder}/p.shard{k}.jsonl")
    rows = R.read_jsonl(spark, R.shard_paths(spark, folder, "p"), "sample_id string").select(F.regexp_extract(F.input_file_name(), r"shard(\d+)", 1).alias("shard"))
    return rows.groupBy("shard").agg(F.count("*").alias("n"))


@query("SRC07", "SELECT 'teacher' AS side, count(*) AS n FROM rec WHERE error IS NULL AND doc_id % 3 > 0 UNION ALL SELECT 'student', count(*) FROM rec WHERE error IS NULL AND doc_id % 3 = 0", rec=REC)
def src07(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "src07")
    rows = _rec(spark, sf)
    for name, k in (("teacher.a", 1), ("teacher.b", 2), ("student.a", 0)):
        K.write_jsonl(rows.where(F.col("doc_id") % 3 == k).select("sample_id", "error"), f"{folder}/{name}.jsonl")
    both = R.glob_pair(spark, folder, "teacher.*.jsonl", "student.*.jsonl", "sample_id string, error string")
    return sets.concat_all(*[df.agg(F.lit(side).alias("side"), F.count("*").alias("n")) for side, df in zip(("teacher", "student"), both)])


def _virl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "virl")
    kind = F.when(F.col("kind") == 0, F.lit("no box")).when(F.col("kind") == 1, F.lit("\\boxed{}")).otherwise(F.concat(F.lit("so \\boxed{ \\frac{1}{"), "qid", F.lit("} }")))
    run(spark, sf, VIRL_SQL).select("*", kind.alias("answer"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.col("n_images").cast("int")).alias("image")).drop("kind", "n_images").write.parquet(path)
    return spark.read.parquet(path)


@query("SRC08", "SELECT qid AS sample_id, 'what is ' || qid AS question, CASE kind WHEN 1 THEN '' ELSE '\\frac{1}{' || qid || '}' END AS gold, category, source, PassRate_32BTrained AS pass_rate FROM v WHERE PassRate_32BTrained BETWEEN 0.3 AND 0.9 AND n_images = 1 AND kind <> 0", v=VIRL_SQL)
def src08(spark: SparkSession, sf: str) -> DataFrame:
    return D.load_virl(_virl(spark, sf)).drop("image_paths")


@query("SRC09", "SELECT 'vlmbias_main' AS dataset, sample_id, 'q' AS question, gold, prior AS expected_bias, topic FROM rec", rec=REC)
def src09(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "src09")
    rows = _rec(spark, sf).select(F.col("sample_id").alias("ID"), F.lit("q").alias("prompt"), F.col("gold").alias("ground_truth"), F.col("prior").alias("expected_bias"), "topic")
    names = rows.columns

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        schema = pa.schema([(c, pa.string()) for c in names])
        with store.open_output_stream(f"{base}/{TaskContext.get().partitionId():05d}.arrow") as out, pa.ipc.new_stream(out, schema) as writer:
            for b in batches:
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in b.columns], schema=schema))
        yield pa.RecordBatch.from_pydict({"ok": [True]})

    rows.mapInArrow(write, "ok boolean").count()
    return R.sample_vlmbias(R.read_arrow(spark, f"{folder}/*.arrow", ", ".join(f"{c} string" for c in names)), "main")


@query("SRC10", "SELECT CASE WHEN doc_id % 5 IN (0, 1) THEN CAST(doc_id + 7 AS STRING) ELSE sample_id END AS sample_id, topic AS question, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS gold, source AS image_source, CASE WHEN doc_id % 3 = 0 THEN 'adversarial' ELSE 'c' END AS category FROM rec", rec=REC)
def src10(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = _rec(spark, sf).select(
        F.when(d % 5 == 0, "").when(d % 5 == 1, "0").otherwise(F.col("sample_id")).alias("id"), (d + 7).alias("question_id"), F.col("topic").alias("question"),
        F.when(d % 2 == 0, "\t Yes \n").otherwise("NO").alias("answer"), F.col("source").alias("image_source"), F.when(d % 3 != 0, "c").alias("category"),
    )
    return R.sample_pope(rows)


@query("SRC11", "SELECT sample_id, topic AS question, gold, CASE WHEN doc_id % 3 = 0 THEN 't' || sample_id END AS task, CASE WHEN doc_id % 3 = 0 THEN source END AS source FROM rec", rec=REC)
def src11(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    meta = F.when(d % 3 == 0, F.to_json(F.struct(F.concat(F.lit("t"), "sample_id").alias("task"), "source"))).when(d % 3 == 1, "{broken")
    return R.sample_mathvista(_rec(spark, sf).select(F.col("sample_id").alias("pid"), F.col("topic").alias("question"), F.col("gold").alias("answer"), meta.alias("metadata")))


@query("SRC12", "SELECT dataset, count(*) AS n FROM rec GROUP BY dataset", rec=REC)
def src12(spark: SparkSession, sf: str) -> DataFrame:
    registry = R.Registry()
    for name in ("vlmbias_main", "pope_adversarial", "mathvista_mini"):
        registry.add(name)(lambda rows, name=name: rows.where(F.col("dataset") == name).select("dataset"))
    rows = _rec(spark, sf)
    return sets.concat_all(*[registry.load(name, rows) for name in sorted(registry.known)]).groupBy("dataset").agg(F.count("*").alias("n"))


@query("SRC13", "SELECT n_nationkey AS k, n_name AS name, shape FROM nation, (VALUES ('lines'), ('list'), ('data')) AS s(shape)")
def src13(spark: SparkSession, sf: str) -> DataFrame:
    rows = run(spark, sf, "SELECT n_nationkey AS k, n_name AS name FROM nation")
    whole = F.to_json(F.sort_array(F.collect_list(F.struct("k", "name"))))  # a list file is one document: 25 nations here
    lines = _jsonl(rows, "src13", ".jsonl")
    listed, data = scratch(spark, "src13-list"), scratch(spark, "src13-data")
    rows.agg(whole).write.text(listed)
    rows.agg(F.concat(F.lit('{"data": '), whole, F.lit("}"))).write.text(data)
    return sets.concat_all(*[R.read_json_any(spark, p, "k int, name string").withColumn("shape", F.lit(s)) for s, p in (("lines", lines), ("list", listed), ("data", data))])


@query("SRC14", "SELECT r_name AS cat, count(*) AS n_images, count(DISTINCT n_name) AS n_files FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def src14(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = (run(spark, sf, f"SELECT * FROM {t}") for t in ("nation", "region"))
    path = scratch(spark, "src14")
    doc = nation.agg(F.collect_list(F.struct(F.col("n_nationkey").alias("image_id"), F.col("n_regionkey").alias("category_id"))).alias("annotations"), F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("file_name"))).alias("images"))
    cats = region.agg(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))).alias("categories"))
    doc.join(cats).select(F.to_json(F.struct("*"))).write.text(path)
    categories, annotations, images = R.read_coco(spark, path)
    named = annotations.join(images.withColumnRenamed("id", "image_id"), "image_id").join(categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    return named.groupBy(F.col("name").alias("cat")).agg(F.count("*").alias("n_images"), F.countDistinct("file_name").alias("n_files"))


@query("SRC15", "SELECT DISTINCT doc_id % 40 AS image_id FROM documents")
def src15(spark: SparkSession, sf: str) -> DataFrame:
    rows = run(spark, sf, "SELECT 'none' AS image, 'COCO_val2014_0000' || CAST(doc_id % 40 AS STRING) || '.JPG' AS image_source FROM documents")
    return R.first_ids(rows, ["image_id", "image", "image_source"])


_REF = "sample_id, unique_key, source_tag, image_id"


@query("SRC16", "SELECT 'pope_' || sample_id AS sample_id, 'id:' || CAST(doc_id % 40 AS STRING) AS unique_key, 'pope' AS source_tag, doc_id % 40 AS image_id FROM rec WHERE dataset = 'pope_adversarial'", rec=REC)
def src16(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf).where("dataset = 'pope_adversarial'")
    return R.image_refs(rows, "pope", F.concat(F.lit("pope_"), "sample_id"), F.col("doc_id") % 40).drop("path")


@query("SRC17", "SELECT sample_id, 'vlmbias#' || sample_id AS unique_key, 'vlmbias' AS source_tag FROM rec WHERE dataset = 'vlmbias_main'", rec=REC)
def src17(spark: SparkSession, sf: str) -> DataFrame:
    return R.image_refs(_rec(spark, sf).where("dataset = 'vlmbias_main'"), "vlmbias", F.col("sample_id"), ordinal=F.col("doc_id")).drop("path", "image_id")


@query("SRC18", "SELECT CASE doc_id % 4 WHEN 0 THEN 'pope_style' WHEN 1 THEN 'tallyqa' WHEN 2 THEN 'synth' ELSE 'virl39k' END AS source_tag, count(*) AS n, count(DISTINCT CASE WHEN doc_id % 4 < 2 THEN CAST(doc_id % 40 AS STRING) ELSE sample_id END) AS n_keys FROM rec GROUP BY 1", rec=REC)
def src18(spark: SparkSession, sf: str) -> DataFrame:
    rows, refs = _rec(spark, sf), []
    for k, tag in enumerate(("pope_style", "tallyqa", "synth", "virl39k")):
        part = rows.where(F.col("doc_id") % 4 == k)
        refs.append(R.image_refs(part, tag, F.col("sample_id"), F.col("doc_id") % 40) if k < 2 else R.image_refs(part, tag, F.col("sample_id"), path=F.concat_ws("/", F.lit(tag), "sample_id")))
    return sets.concat_all(*refs).groupBy("source_tag").agg(F.count("*").alias("n"), F.countDistinct("unique_key").alias("n_keys"))


@query("SRC19", "SELECT sample_id, 'q' AS question, gold, 'dir/' || sample_id || '.png' AS image_path, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE topic END AS topic, 'synthetic' AS source FROM rec", rec=REC)
def src19(spark: SparkSession, sf: str) -> DataFrame:
    extras = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("own").alias("topic")))
    rows = _rec(spark, sf).select("sample_id", "topic", F.concat("sample_id", F.lit(".png")).alias("image_path"), F.lit("q").alias("question"), "gold", extras.alias("extras"))
    return R.read_synth_manifest(spark, _jsonl(rows, "src19"), "dir")


@query("SRC20", "SELECT sample_id, topic AS bucket, gold, source AS tag FROM rec", rec=REC)
def src20(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf).select("sample_id", F.col("topic").alias("bucket"), F.lit("q").alias("question"), "gold", F.lit("p").alias("image_path"), F.struct(F.col("source").alias("tag")).alias("extras"))
    return R.read_mixture(spark, _jsonl(rows, "src20")).select("sample_id", "bucket", "gold", F.try_variant_get("extras", "$.tag", "string").alias("tag"))


@query("SRC21", "SELECT 'virl' AS bucket, count(*) AS n FROM v WHERE PassRate_32BTrained BETWEEN 0.3 AND 0.9 AND n_images = 1 AND kind <> 0 UNION ALL SELECT 'tally', count(*) FROM t WHERE NOT coalesce(issimple, false) AND image <> '' AND NOT (data_source = 'COCO2014' AND image_id % 5 = 0) AND TRY_CAST(answer AS BIGINT) BETWEEN 0 AND 15", v=VIRL_SQL, t=TALLY_SQL)
def src21(spark: SparkSession, sf: str) -> DataFrame:
    registry = R.Registry()
    registry.add("virl")(lambda: D.load_virl(_virl(spark, sf)))
    registry.add("tally")(lambda: D.load_tally(run(spark, sf, TALLY_SQL), run(spark, sf, "SELECT doc_id AS image_id FROM documents WHERE doc_id % 5 = 0")))
    return sets.concat_all(*[registry.load(b).agg(F.lit(b).alias("bucket"), F.count("*").alias("n")) for b in sorted(registry.known)])


@query("SRC22", "SELECT count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM log", log=LOG)
def src22(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "src22")
    run(spark, sf, LOG).select("line").write.text(path)
    return R.read_log(spark, path).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("n_chars"))


@query("SRC23", "SELECT r_regionkey AS k, CAST(length(r_name) + 1 AS BIGINT) AS n_bytes FROM region")
def src23(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "src23")
    run(spark, sf, "SELECT r_regionkey AS k, r_name AS value FROM region").write.partitionBy("k").text(folder)
    files = R.read_binary(spark, f"{folder}/*/part-*")
    return files.select(F.regexp_extract("path", r"k=(\d+)", 1).cast("int").alias("k"), F.length("bytes").cast("bigint").alias("n_bytes"))


@query("SRC24", "SELECT c_nationkey AS seed, count(*) AS n_virl, 1600 AS n_pope_style, 0.5 + (c_nationkey % 50) / 100.0E0 AS cosine_threshold, CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 0 END AS n_skip FROM customer GROUP BY c_nationkey")
def src24(spark: SparkSession, sf: str) -> DataFrame:
    """A settings file for each nation of the customers, written from the table and read back."""
    runs = run(spark, sf, "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey")
    share = F.format_string("%.2f", 0.5 + (F.col("k") % 50) / 100.0)
    skip = F.when(F.col("k") % 2 == 0, "skip: [virl, 'tally']").otherwise("# nothing is skipped")
    text = F.concat(F.lit("seed: "), "k", F.lit("  # a nation\n\nn_virl: "), "n", F.lit("\ncosine_threshold: "), share, F.lit("\n"), skip)
    path = scratch(spark, "src24")
    runs.select("k", text.alias("value")).repartition(8, "k").write.partitionBy("k").text(path)
    found = settings_of_files(spark, f"{path}/k=*")
    return found.select("seed", "n_virl", F.col("n_pope_style").cast("int").alias("n_pope_style"), F.round("cosine_threshold", 6).alias("cosine_threshold"), F.size("skip").alias("n_skip"))


@query("SRC25", "SELECT 'A' AS config, topic, count(*) AS n FROM rec GROUP BY topic UNION ALL SELECT 'B', topic, count(*) FROM rec WHERE correct_i GROUP BY topic", rec=REC)
def src25(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf)
    made = {c: _jsonl(df.groupBy("topic").agg(F.count("*").alias("n")), f"src25-{c}") for c, df in (("A", rows), ("B", rows.where("correct_i")))}
    return R.read_metric_rows(spark, made | {"C": scratch(spark, "missing")}, "topic string, n bigint")


@query("SNK01", f"SELECT {_PLAIN} FROM rec", rec=REC)
def snk01(spark: SparkSession, sf: str) -> DataFrame:
    """Appended in two jobs, the second of which gets all rows but works only on those that aren't there."""
    path = scratch(spark, "snk01")
    rows = _rec(spark, sf).select("sample_id", "dataset", "topic", "n_chars", "mean_delta")
    append_jsonl(rows.where("n_chars % 2 = 0"), path, "sample_id", flush=50)
    append_jsonl(rows, path, "sample_id", flush=50)
    return read_appended(spark, path, RECORD).drop("error")


@query("SNK02", "SELECT sample_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'ValueError: ' || error END AS error FROM rec", rec=REC)
def snk02(spark: SparkSession, sf: str) -> DataFrame:
    """Records are made in the writing task and flushed one by one; where a sample fails, its record tells."""
    path = scratch(spark, "snk02")

    def model(sample: dict) -> dict:
        if sample["error"] is not None:
            raise ValueError(sample["error"])
        return {"sample_id": sample["sample_id"], "error": "ok"}

    evaluation.produce_resumably(_rec(spark, sf).select("sample_id", "error"), model, path)
    return read_appended(spark, path, "sample_id string, error string")


@query("SNK03", "SELECT topic AS bucket, count(*) AS n FROM rec GROUP BY topic", rec=REC)
def snk03(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "snk03")
    K.write_jsonl(_rec(spark, sf).select("sample_id", F.col("topic").alias("bucket")), path, by="bucket")
    return spark.read.schema("sample_id string, bucket string").json(path).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SNK04", "SELECT 'id' AS layer, count(*) AS n FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 = 0 UNION ALL SELECT 'hash', count(*) FROM documents WHERE doc_id % 7 = 0")
def snk04(spark: SparkSession, sf: str) -> DataFrame:
    from siftwell.operators.joins import leak_findings

    docs = run(spark, sf, "SELECT doc_id FROM documents")
    hits = [leak_findings(docs.where(cond).withColumn("e", F.col("doc_id")), layer, "doc_id", "e", F.lit(0)) for layer, cond in (("id", "doc_id % 3 = 0 AND doc_id % 5 = 0"), ("hash", "doc_id % 7 = 0"))]
    return K.write_findings(sets.concat_all(*hits), scratch(spark, "snk04"))[0]


@query("SNK05", "SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def snk05(spark: SparkSession, sf: str) -> DataFrame:
    turns = run(spark, sf, "SELECT conv_id, turn, role, text FROM conversations")
    nested = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("prompt"))
    rows = spark.read.parquet(K.write_train(nested, scratch(spark, "snk05")))
    return rows.select("conv_id", F.size("prompt").cast("bigint").alias("n_turns"), F.aggregate("prompt", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t["text"])).alias("n_chars"))


@query("SNK06", "SELECT topic, round(avg(mean_delta), 6) AS \"m.mean\", count(*) AS \"m.n\" FROM rec GROUP BY topic", rec=REC)
def snk06(spark: SparkSession, sf: str) -> DataFrame:
    tree = _rec(spark, sf).groupBy("topic").agg(F.struct(F.count("*").alias("n"), F.round(F.avg("mean_delta"), 6).alias("mean")).alias("m"))
    path = K.write_csv(tree, scratch(spark, "snk06"))
    return spark.read.option("header", True).schema("`m.mean` double, `m.n` bigint, topic string").csv(path)


_STEPS = "SELECT step, max(value) FILTER (metric = 'actor/loss') AS \"actor/loss\", max(value) FILTER (metric = 'perf/x') AS \"perf/x\" FROM s WHERE metric IN ('actor/loss', 'perf/x') GROUP BY step"


@query("SNK07", _STEPS, s=f"SELECT * FROM ({SERIES}) QUALIFY row_number() OVER (PARTITION BY step, metric ORDER BY line_no DESC) = 1")
def snk07(spark: SparkSession, sf: str) -> DataFrame:
    series = last_by_step(log_series(run(spark, sf, LOG)).where("metric IN ('actor/loss', 'perf/x')"))
    path = K.write_csv(K.pivot_steps(series), scratch(spark, "snk07"), first=("step",))
    return spark.read.option("header", True).schema("step bigint, `actor/loss` double, `perf/x` double").csv(path)


@query("SNK08", "SELECT topic, count(*) AS n, max(n_chars) AS longest FROM rec GROUP BY topic", rec=REC)
def snk08(spark: SparkSession, sf: str) -> DataFrame:
    path = K.write_csv(_rec(spark, sf).groupBy("topic").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")), scratch(spark, "snk08"), order="as is")
    return spark.read.option("header", True).schema("topic string, n bigint, longest bigint").csv(path)


@query("SNK09", "SELECT '{\"topic\":\"' || topic || '\",\"n\":' || CAST(count(*) AS STRING) || '}' AS report FROM rec GROUP BY topic", rec=REC)
def snk09(spark: SparkSession, sf: str) -> DataFrame:
    return K.json_report(_rec(spark, sf).groupBy("topic").agg(F.count("*").alias("n")))


@query("SNK10", "SELECT '# Topics' || chr(10) || chr(10) || '| topic | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || topic || ' | ' || n || ' |' || chr(10), '' ORDER BY topic) AS report FROM (SELECT topic, count(*) AS n FROM rec GROUP BY topic)", rec=REC)
def snk10(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(K.markdown(_rec(spark, sf).groupBy("topic").agg(F.count("*").alias("n")).orderBy("topic"), "Topics"),)], "report string")


@query("SNK11", "SELECT rtrim(rpad(topic, 10, ' ') || rpad(CAST(count(*) AS STRING), 8, ' ') || rpad('-', 8, ' ')) AS line FROM rec GROUP BY topic", rec=REC)
def snk11(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf).groupBy("topic").agg(F.count("*").alias("n"), F.max(F.lit(None).cast("double")).alias("x"))
    return K.fixed_width(rows, {"topic": 10, "n": 8, "x": 8})


@query("SNK12", "SELECT CAST(least(floor(mean_delta * 59) + 1, 59) AS BIGINT) AS bin, count(*) AS n FROM rec GROUP BY 1", rec=REC)
def snk12(spark: SparkSession, sf: str) -> DataFrame:
    return S.histogram(_rec(spark, sf), "mean_delta", 0.0, 1.0, 59).select("bin", "n")
