"""Whole runs over literal records, against figures counted here in plain Python."""

import json
import statistics

import pytest

from siftwell.cli import main
from siftwell.lifecycles import curation, diagnosis, evaluation
from siftwell.lifecycles.records import scan
from siftwell.sources.records import read_jsonl


def record(i, dataset, **own):
    """A diagnostic record by arithmetic on i."""
    base = {
        "dataset": dataset, "sample_id": f"{dataset}-{i}", "gold": str(i % 3), "ans_T_I": f"it is {{{i % 4}}}", "correct_I": i % 4 == i % 3, "correct_null": i % 5 == 0,
        "response_tokens": ["a", "b", "c"], "delta_t": [i % 7 / 7, i % 5 / 5, i % 3 / 3] if i % 6 else [], "extras": {"topic": ("Flags", "Illusion")[i % 2], "expected_bias": "x"},
        "option_logP": {"I": {"ground_truth": -1.0 - i % 3, "expected_bias": -2.0}, "null": {"ground_truth": -2.0, "expected_bias": -1.0 - i % 2}},
    }
    return base | own


def write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("results")
    bias = [record(i, "vlmbias_main") for i in range(40)]
    yes = [record(i, "pope_adversarial", gold=("Yes", "no")[i % 2], ans_T_I=("yes, so", "No", "who knows", "Yes")[i % 4], extras={}) for i in range(20)]
    free = [record(i, "mathvista_mini", ans_T_I=("", "b) so", "blue", "seven")[i % 4], extras={"question_type": ("multi_choice", "free_form")[i % 2], "choices": ["Blue", "red"]}) for i in range(12)]
    write(at, "teacher_1.jsonl", bias[:25] + yes)
    write(at, "teacher_2.jsonl", bias[25:] + free + [{"dataset": "vlmbias_main", "sample_id": "bad", "error": "boom"}])
    student = [record(i, "vlmbias_main", ans_T_I=f"{{{(i * 5) % 4}}}", correct_I=(i * 5) % 4 == i % 3) for i in range(3, 38)]
    write(at, "student_1.jsonl", [record(5, "vlmbias_main", ans_T_I="{old}", correct_I=False), *student])
    return at


def mean(xs):
    return statistics.mean(xs) if xs else None


def test_metrics_command(spark, folder):
    assert main(["metrics", "--results-dir", str(folder)], spark) == 0
    got = {r["group"]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/summary.csv").collect()}
    assert set(got) == {"vlmbias", "vlmbias_main / Flags", "vlmbias_main / Illusion", "pope", "mathvista"}
    rows = [record(i, "vlmbias_main") for i in range(40)]
    for group, mine in (("vlmbias", rows), ("vlmbias_main / Flags", rows[::2])):
        r = got[group].asDict()
        assert r["m1_acc.n"] == len(mine) and r["m1_acc.acc_I"] == pytest.approx(mean([x["correct_I"] for x in mine]))
        deltas = [(statistics.mean(x["delta_t"]), x["correct_I"]) for x in mine if x["delta_t"]]
        assert r["m2_mean_delta.n_with_delta"] == len(deltas)
        assert r["m2_mean_delta.mean_delta_wrong"] == pytest.approx(mean([d for d, c in deltas if not c]))
        gain = lambda k: mean([x["option_logP"]["I"][k] - x["option_logP"]["null"][k] for x in mine])
        assert r["m3_visual_gain.gain_margin"] == pytest.approx(gain("ground_truth") - gain("expected_bias"))
        pairs = [(x, (i * 5) % 4) for x in mine if 3 <= (i := int(x["sample_id"].split("-")[1])) < 38]
        both = [(x, s) for x, s in pairs if not x["correct_I"] and str(s) != x["gold"]]
        assert r["m5a_student_teacher_overlap.n_both_wrong"] == len(both)
        assert r["m5a_student_teacher_overlap.n_same_wrong"] == sum(f"{{{s}}}" in x["ans_T_I"] for x, s in both)
    assert got["pope"]["m5b_hallucinated_grounded.n_grounded"] == sum(1 for i in range(20) if i % 4 == 0 and i % 6)
    assert got["pope"]["m5b_hallucinated_grounded.n_hallucinated"] == sum(1 for i in range(20) if i % 4 == 3 and i % 6)
    assert got["pope"]["m3_visual_gain.gain_margin"] is None
    tokens = json.loads((folder / "top_delta_tokens.json").read_text())
    want = sorted(((max(x["delta_t"]), x["sample_id"]) for x in rows if x["delta_t"]), key=lambda p: (-p[0], p[1]))
    assert [(t["delta"], t["context_sample_id"]) for t in tokens["vlmbias_dedup_by_sample"]] == want
    assert set(tokens["vlmbias_by_topic"]) == {"Flags", "Illusion"} and len(tokens["vlmbias_by_topic"]["Flags"]) <= 20
    assert "of the automatic criteria hold" in (folder / "verdict.md").read_text()


def test_metrics_of_no_student_and_lengths(spark, folder):
    teacher, none = scan(spark, f"{folder}/teacher_*.jsonl"), scan(spark, [])
    row = next(r for r in diagnosis.metrics(teacher, none, count=len).collect() if r.group == "vlmbias")
    assert row.m5a_student_teacher_overlap.n_both_wrong == 0 and row.m5a_student_teacher_overlap.overlap_rate is None
    assert row.m3_visual_gain.gain_margin_lengthnorm == pytest.approx(row.m3_visual_gain.gain_margin)  # every text has one character
    assert row.m3_visual_gain.n_skipped_lengthnorm == 0
    assert {r.topic: r.n for r in diagnosis.figures(teacher)["margins"].collect()} == {"Flags": 20, "Illusion": 20}
    assert diagnosis.metrics(none, none).count() == 0


def test_evaluate_command(spark, folder, tmp_path):
    teacher, student = (f"{folder}/{p}_*.jsonl" for p in ("teacher", "student"))
    rows = [json.loads(x) for f in ("teacher_1.jsonl", "teacher_2.jsonl") for x in (folder / f).read_text().splitlines()]
    for d in ("vlmbias_main", "pope_adversarial", "mathvista_mini"):
        write(tmp_path, f"{d}.jsonl", [r for r in rows if r["dataset"] == d])
    at = {d: str(tmp_path / f"{d}.jsonl") for d in ("vlmbias_main", "pope_adversarial", "mathvista_mini")}
    argv = ["evaluate", "--student-vlmbias-jsonl", student, "--teacher-vlmbias-jsonl", at["vlmbias_main"], "--student-pope-jsonl", at["pope_adversarial"], "--student-mathvista-jsonl", at["mathvista_mini"]]
    assert main([*argv, "--student-base-vlmbias-jsonl", student, "--output", str(tmp_path / "own.json")], spark) == 0
    own = json.loads((tmp_path / "own.json").read_text())
    wrong = [i for i in range(3, 38) if i % 4 != i % 3]
    assert own["tei"]["n_t_wrong_with_student"] == len(wrong) and own["tei"]["n_s_matches_t_wrong_answer"] == sum((i * 5) % 4 == i % 4 for i in wrong)
    assert own["tei"]["n_escaped"] == 0  # its own base
    base = [record(i, "vlmbias_main", ans_T_I=f"{{{i % 4}}}", correct_I=False) for i in range(40)]
    write(tmp_path, "base.jsonl", base)
    mixed = [record(i, "vlmbias_main", ans_T_I=f"{{{i % 3 if i % 2 else 9}}}", correct_I=i % 2 == 1) for i in range(40)]
    write(tmp_path, "mixed.jsonl", mixed)
    argv[2] = str(tmp_path / "mixed.jsonl")
    assert main([*argv, "--student-base-vlmbias-jsonl", str(tmp_path / "base.jsonl"), "--output", str(tmp_path / "b.json")], spark) == 0
    out = json.loads((tmp_path / "b.json").read_text())
    wrong = [i for i in range(40) if i % 4 != i % 3]
    # another wrong answer than the teacher's is no escape
    assert (out["tei"]["n_base_inherited"], out["tei"]["n_escaped"]) == (len(wrong), sum(i % 2 for i in wrong))
    assert out["vlmbias"]["recognition_aggregate"]["n"] == 20 == out["vlmbias"]["per_topic"]["Flags"]["n"]
    yes = [(("yes", "no", "no", "yes")[i % 4], ("yes", "no")[i % 2]) for i in range(20)]  # 'who knows' holds 'no'
    assert out["pope"]["accuracy"] == pytest.approx(mean([p == g for p, g in yes])) and out["pope"]["tp"] == 5 == out["pope"]["fp"]
    assert out["mathvista"]["parse_success_rate"] == pytest.approx(mean([i % 4 != 0 for i in range(12)]))
    assert out["_counts"]["vlmbias_student_base"] == 40


def test_produce_tells_errors(spark):
    samples = spark.createDataFrame([("a", "q"), ("b", "")], "sample_id string, question string")
    fn = lambda s: {"sample_id": s["sample_id"], "n": len(s["question"]) // len(s["question"])}
    got = {r.sample_id: r for r in evaluation.produce(samples, fn, "sample_id string, n bigint, error string").collect()}
    assert got["a"].n == 1 and got["a"].error is None
    assert got["b"].n is None and got["b"].error.startswith("ZeroDivisionError")


def test_mixture_leaks_and_training_rows(spark, tmp_path):
    root = tmp_path / "virl"
    rows = [(f"<image>what {i}", f"\\boxed{{{i}}}", 0.5 if i % 4 else 0.95, 0.1, ("x", "y")[i % 2], "s", f"q{i}", [f"{i}.png"]) for i in range(40)]
    spark.createDataFrame(rows, "question string, answer string, PassRate_32BTrained double, PassRate_7BBase double, category string, source string, qid string, image array<string>").write.parquet(f"{root}/39Krelease.parquet")
    for i in range(40):
        (root / f"{i}.png").write_bytes(b"picture %d" % (i % 37))
    (tmp_path / "coco.json").write_text(json.dumps({
        "categories": [{"id": k, "name": f"thing{k}"} for k in range(1, 6)], "images": [{"id": i, "file_name": f"{i}.jpg"} for i in range(30)],
        "annotations": [{"image_id": i, "category_id": 1 + (i + j) % 4} for i in range(30) for j in range(2)]}))
    spark.createDataFrame([(i,) for i in range(0, 30, 3)], "image_id bigint").write.parquet(f"{tmp_path}/ids")
    out = str(tmp_path / "mix.jsonl")
    argv = ["mixture", "--output", out, "--virl39k-root", str(root), "--coco-annotations", str(tmp_path / "coco.json"), "--eval-ids", f"{tmp_path}/ids", "--n-virl39k", "12", "--n-pope-style", "16"]
    assert main(argv, spark) == 0
    mixed = spark.read.json(out).collect()
    virl, pope = ([r for r in mixed if r.bucket == b] for b in ("virl39k", "pope_style"))
    assert len(virl) == 12 and all(r.extras.pass_rate_32b == 0.5 and int(r.sample_id[1:]) % 4 for r in virl)
    assert len(pope) == 16 and sum(r.gold == "Yes" for r in pope) == 8 and all(r.extras.image_id % 3 for r in pope)
    for r in pope:
        has = {1 + (r.extras.image_id + j) % 4 for j in range(2)}
        assert (r.extras.category_id in has) == (r.gold == "Yes") and r.question == f"Is there a thing{r.extras.category_id} in the image?"

    # an evaluation image that equals one of the training images
    picked = virl[0].image_path
    write(tmp_path, "evals.jsonl", [{"sample_id": "e1", "bucket": "eval", "image_path": str(tmp_path / "e" / "same.png"), "extras": {"image_id": 3}}])
    (tmp_path / "e").mkdir()
    with open(picked, "rb") as f:
        (tmp_path / "e" / "same.png").write_bytes(f.read())
    check = ["dedup-check", "--train", out, "--evals", str(tmp_path / "evals.jsonl"), "--images", f"{root}/*.png", "--eval-images", f"{tmp_path}/e/*.png", "--output", f"{tmp_path}/found"]
    assert main(check, spark) == 1
    found = spark.read.json(f"{tmp_path}/found").collect()
    same = {r.sample_id for r in virl if int(r.sample_id[1:]) % 37 == int(virl[0].sample_id[1:]) % 37}
    assert {(r.layer, r.train_sample_id, r.eval_sample_id, r.distance) for r in found} == {("phash", s, "e1", 0.0) for s in same}

    def vectors(blobs):
        return [[float(sum(b)), float(len(b)), 1.0] for b in blobs]

    refs = curation.manifest_refs(read_jsonl(spark, [out], "sample_id string, bucket string, image_path string, extras variant"))
    evals = curation.manifest_refs(read_jsonl(spark, [str(tmp_path / "evals.jsonl")], "sample_id string, bucket string, image_path string, extras variant"))
    files = spark.read.format("binaryFile").load([f"{root}/*.png", f"{tmp_path}/e/*.png"]).withColumnRenamed("content", "bytes")
    near = curation.leak_check(refs, evals, None, files, embed_fn=vectors, layers=("clip",), threshold=0.5).collect()
    assert len(near) == len({r.image_path for r in virl}) and all(r.eval_sample_id == "e1" for r in near)

    records = [{"bucket": r.bucket, "sample_id": r.sample_id, "image_paths": [r.image_path], "question": r.question, "gold": r.gold, "correct_I": True, "pass_rate_32b": 0.5} for r in virl]
    records += [{"bucket": "other", "sample_id": "z"}, {"bucket": "virl39k", "sample_id": "q1", "question": "?", "gold": " 1 "}, {"bucket": "virl39k", "sample_id": "q2", "error": "boom"}, records[0] | {"sample_id": "blank", "gold": " "}]
    write(tmp_path, "pre.jsonl", records)
    argv = ["train-parquet", "--jsonl", str(tmp_path / "pre.jsonl"), "--images", f"{root}/*.png", "--virl39k-root", str(root), "--output", f"{tmp_path}/train"]
    assert main(argv, spark) == 0
    table = spark.read.parquet(f"{tmp_path}/train").collect()
    assert len(table) == 13 and sorted(r.extra_info["index"] for r in table) == list(range(13))
    one = next(r for r in table if r.sample_id == "q1" and not r.trajectory_pass)
    assert (one.ability, one.gold_text, one.gold_response_text, bytes(one.images[0].bytes)) == ("vl_distill", "1", "Final answer: \\boxed{1}.", b"picture 1")


TOPICS = {"sum": lambda seed, idx: (idx.cast("string"), (idx + 1).cast("string")), "id": lambda seed, idx: (seed.cast("string"), seed.cast("string"))}


def test_synthesize_and_sanity(spark, tmp_path):
    argv = ["synthesize", "--out-dir", str(tmp_path), "--topics", "tests.test_lifecycles:TOPICS", "--n-samples", "10"]
    assert main([*argv, "--topic-weights", '{"sum": 1}'], spark) == 0
    assert {r.topic for r in spark.read.json(f"{tmp_path}/manifest.jsonl").collect()} == {"sum"}
    with pytest.raises(KeyError):
        main([*argv, "--topic-weights", '{"none": 1}'], spark)
    animal = lambda i, **own: {"sample_id": str(i), "dataset": "synthetic", "ans_T_I": "4", "correct_I": False, "extras": {"topic": "animal", "canonical_legs": 4, "is_counterfactual": True}} | own
    write(tmp_path, "ok.jsonl", [animal(0), animal(1, ans_T_I="7"), animal(2, correct_I=True), animal(3, error="x")])
    write(tmp_path, "easy.jsonl", [animal(i, correct_I=True) for i in range(3)])
    write(tmp_path, "none.jsonl", [animal(0, extras={"topic": "flag"})])
    for name, code, verdict in (("ok", 0, "PASS"), ("easy", 1, "FAIL too easy"), ("none", 1, "INCONCLUSIVE")):
        assert main(["synth-sanity", str(tmp_path / f"{name}.jsonl"), "--out", str(tmp_path / f"r-{name}")], spark) == code
        assert json.loads((tmp_path / f"r-{name}.json").read_text())["gate"]["verdict"] == verdict


def test_train_log_command(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_text("noise\nx training/global_step: 1 actor/loss=2.0 actor/e1_v1/kl_ce_ratio=0.9\nx training/global_step: 1 actor/loss=3.0\nx training/global_step: 2 actor/loss=4.0 actor/e1_v1/kl_ce_ratio=0.65\n")
    assert main(["train-log", str(log), "--out", str(tmp_path / "r"), "--config", "C"], spark) == 0
    assert main(["train-log", str(log), "--out", str(tmp_path / "s"), "--kl-ce-band", "0.4", "0.6"], spark) == 1
    out = json.loads((tmp_path / "r.json").read_text())
    spans = {r["metric"]: r for r in out["per_metric_range"]}
    assert (spans["actor/loss"]["min"], spans["actor/loss"]["last"], out["meta"]["n_steps"]) == (3.0, 4.0, 2)
    (tmp_path / "empty.log").write_text("nothing\n")
    assert main(["train-log", str(tmp_path / "empty.log"), "--out", str(tmp_path / "e")], spark) == 1
    assert main(["train-log", str(tmp_path / "absent.log"), "--out", str(tmp_path / "a")], spark) == 2
