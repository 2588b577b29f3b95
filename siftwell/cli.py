"""Command line: python -m siftwell COMMAND. Each command calls one lifecycle; --help lists its parameters."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.lifecycles import curation, diagnosis, evaluation, runs
from siftwell.lifecycles.records import scan, token_counter
from siftwell.operators.sampling import allocate
from siftwell.operators.windows import round_robin
from siftwell.plans import generators
from siftwell.plans.config import Settings
from siftwell.schemas import PRECOMPUTE, SAMPLE, TALLY, VIRL
from siftwell.sources import records as R
from siftwell.sources import sinks as K
from siftwell.streaming.logs import PREFIXES

DEFAULTS = Settings()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small report to any file system Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def load(name: str) -> Callable:
    """A function named as module:function."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _json(document) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _counter(a) -> Callable[[str], int] | None:
    return token_counter(a.tokenizer_path) if a.tokenizer_path else None


def metrics(spark: SparkSession, a) -> int:
    teacher, student = (scan(spark, R._glob(spark, f"{a.results_dir}/{g}")).persist() for g in (a.teacher_glob, a.student_glob))
    groups = diagnosis.metrics(teacher, student, _counter(a)).persist()
    K.write_csv(groups, a.out_csv or f"{a.results_dir}/summary.csv", first=("group",))
    write_text(spark, a.out_verdict or f"{a.results_dir}/verdict.md", diagnosis.report(groups))
    write_text(spark, a.out_tokens or f"{a.results_dir}/top_delta_tokens.json", _json(diagnosis.token_lists(teacher)))
    return 0


def report(spark: SparkSession, a) -> int:
    for name, df in diagnosis.figures(scan(spark, R._glob(spark, f"{a.results_dir}/{a.teacher_glob}"))).items():
        K.write_csv(df, f"{a.out_dir or a.results_dir + '/figures'}/{name}", order="own")
    return 0


def evaluate(spark: SparkSession, a) -> int:
    after, teacher, pope, mathvista = (scan(spark, p, "truthy") for p in (a.student_vlmbias_jsonl, a.teacher_vlmbias_jsonl, a.student_pope_jsonl, a.student_mathvista_jsonl))
    base = scan(spark, a.student_base_vlmbias_jsonl, "truthy") if a.student_base_vlmbias_jsonl else None
    write_text(spark, a.output, _json(evaluation.evaluate(after, teacher, pope, mathvista, base, _counter(a))))
    return 0


def self_test(spark: SparkSession, a) -> int:
    teacher, student = (scan(spark, R.shard_paths(spark, a.results_dir, p)) for p in (a.teacher_prefix, a.student_prefix))
    checks = evaluation.self_test(teacher, student)
    print(_json(checks))
    return int(not all(checks.values()))


def produce(spark: SparkSession, a) -> int:
    """Records of a model given as module:function, over a shard of the samples or all of them; with --resume into a folder of appends."""
    samples = R.read_jsonl(spark, a.samples, a.schema).drop("extras")
    if a.limit is not None:
        samples = samples.orderBy("sample_id").limit(a.limit)
    if a.num_shards > 1:
        samples = round_robin(samples, a.num_shards, "sample_id").where(F.col("shard") == a.shard_index).drop("shard")
    if a.resume:
        evaluation.produce_resumably(samples, load(a.model), a.output)
    else:
        K.write_jsonl(evaluation.produce(samples, load(a.model), a.record_schema), a.output)
    return 0


def _eval_ids(spark: SparkSession, path: str | None) -> DataFrame:
    if not path:
        return spark.createDataFrame([], "image_id bigint")
    return R.first_ids(spark.read.parquet(path), ("image_id", "image_source", "image_name", "file_name"))


def mixture(spark: SparkSession, a) -> int:
    buckets, skip = {}, set(a.skip)
    if a.virl39k_root and a.n_virl39k > 0 and "virl39k" not in skip:
        buckets["virl39k"] = curation.virl_bucket(spark.read.schema(VIRL).parquet(f"{a.virl39k_root}/39Krelease.parquet"), a.n_virl39k, a.seed, a.virl39k_root)
    ids = _eval_ids(spark, a.eval_ids)
    if a.coco_annotations and a.eval_ids and a.n_pope_style > 0 and "pope_style" not in skip:
        buckets["pope_style"] = curation.pope_bucket(*R.read_coco(spark, a.coco_annotations), ids, a.n_pope_style, a.seed + 1, a.coco_images_root or "")
    if a.tallyqa_json and a.eval_ids and a.n_tallyqa > 0 and "tallyqa" not in skip:
        buckets["tallyqa"] = curation.tally_bucket(R.read_json_any(spark, a.tallyqa_json, TALLY), ids, a.n_tallyqa, a.seed + 2, a.tallyqa_images_root or "")
    if a.synth_dir and a.n_synthetic > 0 and "synthetic" not in skip:
        if a.build_synth and not R._glob(spark, f"{a.synth_dir}/manifest.jsonl"):
            _synthesize(spark, a.synth_dir, a.topics, a.n_synthetic, a.seed + 3, None)
        buckets["synthetic"] = curation.synthetic_bucket(R.read_synth_manifest(spark, f"{a.synth_dir}/manifest.jsonl", a.synth_dir), a.n_synthetic, a.seed + 3)
    K.write_jsonl(curation.mixture(buckets), a.output)
    counts = R.read_mixture(spark, a.output).groupBy("bucket").agg(F.count("*").alias("n"))
    print(_json({r.bucket: r.n for r in counts.collect()}))
    return 0


def dedup_check(spark: SparkSession, a) -> int:
    """0 without findings, 1 with findings, 2 where a side has no reference."""
    train, evals = (curation.manifest_refs(R.read_mixture(spark, p)) for p in (a.train, a.evals))
    if not (train.limit(1).count() and evals.limit(1).count()):
        return 2
    layers = tuple(x for x in a.layers if not (a.skip_clip and x == "clip"))
    files = R.read_binary(spark, a.images).unionByName(R.read_binary(spark, a.eval_images or a.images)).dropDuplicates(["path"]) if a.images else None
    ids = _eval_ids(spark, a.eval_ids) if a.eval_ids else evals.where("image_id IS NOT NULL").select("image_id")
    found = curation.leak_check(train, evals, ids, files, a.hash and load(a.hash), a.embed and load(a.embed), layers, a.phash_max_hamming, a.clip_threshold)
    counts, code = K.write_findings(found, a.output)
    print(_json({r.layer: r.n for r in counts.collect()}))
    return code


def train_parquet(spark: SparkSession, a) -> int:
    lookup = None
    if a.virl39k_root:
        from siftwell.sources.datasets import load_virl

        rows = load_virl(spark.read.schema(VIRL).parquet(f"{a.virl39k_root}/39Krelease.parquet"), None, None, require_boxed=False)
        lookup = rows.select("sample_id", F.transform("image_paths", lambda p: F.concat_ws("/", F.lit(a.virl39k_root), p)).alias("image_paths"))
    encode = None
    if a.student_tokenizer:
        encode = token_encoder(a.student_tokenizer)
    files = R.read_binary(spark, a.images)
    table, counts = curation.training_table(R.read_jsonl(spark, a.jsonl, PRECOMPUTE), files, lookup, encode, a.student_tokenizer or "", a.chat_template_version, a.limit)
    K.write_train(table, a.output)
    print(_json({r.reason: r.n for r in counts.collect()}))
    return 0


def token_encoder(path: str) -> Callable[[str], list[int]]:
    cache: dict = {}

    def encode(text: str) -> list[int]:
        from tokenizers import Tokenizer

        if path not in cache:
            cache[path] = Tokenizer.from_file(path)
        return cache[path].encode(text, add_special_tokens=False).ids

    return encode


def _synthesize(spark: SparkSession, out: str, topics: str | None, n: int, seed: int, weights: dict[str, float] | None) -> None:
    """A manifest of n questions by the built-in generators, or by those of topics: module:name of a dict from a topic to a function of
    (seed, idx) columns giving question and gold. Images are drawn elsewhere, at <topic>/<topic>_<idx>.png."""
    from siftwell.plans.pluggable import topic_seed

    known: dict[str, Callable] = load(topics) if topics else generators.GENERATORS
    shares = weights or dict.fromkeys(known, 1.0)
    if set(shares) - set(known):
        raise KeyError(f"{sorted(set(shares) - set(known))} are none of {sorted(known)}")
    counts = allocate({t: shares.get(t, 0.0) for t in known}, n)
    if topics:
        rows = None
        for topic, count in counts.items():
            base = spark.range(count).withColumnRenamed("id", "idx").withColumns({"topic": F.lit(topic), "seed": topic_seed(seed, F.lit(topic))})
            question, gold = known[topic](F.col("seed") + F.col("idx"), F.col("idx"))
            part = base.select("idx", "topic", question.alias("question"), gold.alias("gold"), F.to_json(F.struct("topic")).alias("extras"))
            rows = part if rows is None else rows.unionByName(part)
    else:
        asking = spark.createDataFrame(list(counts.items()), "topic string, n bigint").withColumn("seed", topic_seed(seed, F.col("topic")))
        rows = generators.ask(asking)
    name = F.concat(F.col("topic"), F.lit("_"), F.lpad(F.col("idx").cast("string"), 5, "0"))
    path = F.concat(F.col("topic"), F.lit("/"), name, F.lit(".png"))
    K.write_jsonl(rows.select(F.concat(F.lit("synth_"), name).alias("sample_id"), "topic", path.alias("image_path"), "question", "gold", F.parse_json("extras").alias("extras")), f"{out}/manifest.jsonl")


def synthesize(spark: SparkSession, a) -> int:
    _synthesize(spark, a.out_dir, a.topics, a.n_samples, a.seed, json.loads(a.topic_weights) if a.topic_weights else None)
    R.read_jsonl(spark, f"{a.out_dir}/manifest.jsonl", "sample_id string, question string, gold string").orderBy("sample_id").show(a.n_show, False)
    return 0


def load_bucket(spark: SparkSession, a) -> int:
    """Counts and a few rows of one bucket's loader."""
    ids = _eval_ids(spark, a.eval_ids)
    if a.bucket == "virl39k":
        rows = spark.read.schema(VIRL).parquet(a.path)
        from siftwell.sources.datasets import load_virl

        out = load_virl(rows, None, None) if a.no_pass_rate_filter else load_virl(rows)
    elif a.bucket == "tallyqa":
        out = curation.tally_bucket(R.read_json_any(spark, a.path, TALLY), ids, a.n_samples, a.seed)
    else:
        out = curation.pope_bucket(*R.read_coco(spark, a.path), ids, a.n_samples, a.seed)
    print(out.count())
    out.select("sample_id", "question", "gold").show(a.n_show, False)
    return 0


def train_log(spark: SparkSession, a) -> int:
    """1 where a check fails, 2 where there is no log."""
    if not R._glob(spark, a.log):
        return 2
    series = runs.log_table(spark, a.log, tuple(a.include_prefix)).persist()
    ranges, findings, steps = runs.log_report(series, a.config, tuple(a.kl_ce_band))
    meta = {"log_path": a.log, "config": a.config, "config_name": a.config_name} | steps.first().asDict()
    found, spans = _rows(findings.orderBy("metric")), _rows(ranges.orderBy("metric"))
    table = K.pivot_steps(series)
    K.write_csv(table.orderBy("step"), f"{a.out}.csv", first=("step",))
    write_text(spark, f"{a.out}.json", _json({"meta": meta, "per_metric_range": spans, "health_check": found}))
    heading = f"Run {a.config or 'without a config'}"
    write_text(spark, f"{a.out}.md", K.markdown(findings.orderBy("metric"), heading) + "\n" + K.markdown(ranges.orderBy("metric"), "Ranges", 10_000))
    return int(any(f["severity"] == "fail" for f in found))


def synth_sanity(spark: SparkSession, a) -> int:
    """0 where the gate passes, 1 where it doesn't, 2 where there are no records."""
    if not R._glob(spark, a.jsonl):
        return 2
    topics, gate = runs.synth_report(scan(spark, a.jsonl, "truthy"), a.acc_cf_threshold, a.prior_rate_threshold)
    row = gate.first().asDict()
    K.write_csv(topics, f"{a.out}.csv", first=("topic",))
    write_text(spark, f"{a.out}.json", _json({"per_topic": {r["topic"]: r for r in _rows(topics)}, "gate": row}))
    write_text(spark, f"{a.out}.md", K.markdown(gate, row["verdict"]) + "\n" + K.markdown(topics.orderBy("topic"), "Topics"))
    return int(row["verdict"] != "PASS")


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="siftwell", description="Evaluation of model outputs and curation of training data")
    root.add_argument("--master", help="Spark master; what the job is submitted with if not given")
    sub = root.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *options: tuple) -> None:
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        p.set_defaults(run=run)
        for flag, kw in options:
            p.add_argument(flag, **kw)

    o = lambda flag, default=None, **kw: (flag, {"default": default} | kw)
    need = lambda flag, **kw: (flag, {"required": True} | kw)
    number = lambda flag, default=None: o(flag, default, type=int)
    real = lambda flag, default: o(flag, default, type=float)
    switch = lambda flag: (flag, {"action": "store_true"})
    many = {"nargs": "+"}
    eval_ids = o("--eval-ids", help="parquet with the evaluation images' ids or file names")

    command("metrics", metrics, o("--results-dir", "results"), o("--teacher-glob", "teacher_*.jsonl"), o("--student-glob", "student_*.jsonl"), o("--out-csv"), o("--out-verdict"), o("--out-tokens"), o("--tokenizer-path"))
    command("report", report, o("--results-dir", "results"), o("--teacher-glob", "teacher_*.jsonl"), o("--out-dir"))
    command(
        "evaluate", evaluate, need("--student-vlmbias-jsonl", **many), need("--teacher-vlmbias-jsonl", **many), need("--student-pope-jsonl", **many), need("--student-mathvista-jsonl", **many),
        o("--student-base-vlmbias-jsonl", **many), o("--tokenizer-path"), need("--output"),
    )
    command("self-test", self_test, o("--results-dir", "results"), need("--teacher-prefix"), need("--student-prefix"))
    sharded = (number("--shard-index", 0), number("--num-shards", 1), number("--limit"))
    command("produce", produce, need("--samples", **many), need("--model", help="module:function from a sample's dict to a record's"), o("--schema", SAMPLE), need("--record-schema"), need("--output"), o("--resume", action="store_true", help="append to the output, whatever runs before left there"), *sharded)
    command(
        "mixture", mixture, need("--output"), number("--seed", DEFAULTS.seed), o("--virl39k-root"), o("--coco-images-root"), o("--coco-annotations"), eval_ids, o("--tallyqa-json"), o("--tallyqa-images-root"), o("--synth-dir"),
        switch("--build-synth"), o("--topics"), number("--n-virl39k", DEFAULTS.n_virl), number("--n-pope-style", DEFAULTS.n_pope_style), number("--n-tallyqa", DEFAULTS.n_tally), number("--n-synthetic", DEFAULTS.n_synthetic), o("--skip", [], nargs="*"),
    )
    command(
        "dedup-check", dedup_check, need("--train"), need("--evals"), o("--images"), o("--eval-images"), eval_ids, o("--hash"), o("--embed"), need("--output"), o("--layers", ["image_id", "phash", "clip"], nargs="*"),
        number("--phash-max-hamming", DEFAULTS.max_hamming), real("--clip-threshold", DEFAULTS.cosine_threshold), switch("--skip-clip"),
    )
    command("train-parquet", train_parquet, need("--jsonl", **many), need("--images", help="folder or glob of image files"), o("--virl39k-root"), o("--student-tokenizer"), need("--output"), number("--limit"), o("--chat-template-version", "qwen2_5_vl_default"))
    command("synthesize", synthesize, need("--out-dir"), o("--topics", help="module:name of generators; the built-in ones without it"), number("--n-samples", DEFAULTS.n_synthetic), number("--seed", DEFAULTS.seed), o("--topic-weights"), number("--n-show", 0))
    command("load", load_bucket, ("bucket", {"choices": ["virl39k", "pope_style", "tallyqa"]}), need("--path"), eval_ids, number("--n-samples", 900), number("--seed", DEFAULTS.seed), number("--n-show", 5), switch("--no-pass-rate-filter"))
    command("train-log", train_log, ("log", {}), need("--out"), o("--config", choices=list("ABCD")), o("--config-name"), o("--include-prefix", list(PREFIXES), nargs="*"), o("--kl-ce-band", list(DEFAULTS.kl_ce_band), nargs=2, type=float))
    command("synth-sanity", synth_sanity, ("jsonl", {}), need("--out"), real("--acc-cf-threshold", DEFAULTS.acc_cf_threshold), real("--prior-rate-threshold", DEFAULTS.prior_rate_threshold))
    return root


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from siftwell.session import build_session

        spark = build_session(a.master, None)
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
