"""Evaluation of a trained model: recognition by topic, inherited errors, yes/no answers, free answers; and how records are produced."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions.stats import confusion, percentile, rate
from siftwell.lifecycles.diagnosis import gains
from siftwell.lifecycles.records import FILE_ORDER, RECOGNITION, with_lengths
from siftwell.operators import aggregates as G
from siftwell.operators.joins import three_way
from siftwell.sources.appends import append_jsonl


def recognition(records: DataFrame, count: Callable[[str], int] | None = None) -> DataFrame:
    """(scope, topic, n, accuracy, gains...): all records, each topic, and the recognition topics pooled. Values that aren't finite
    don't enter the gains. Topics are a bounded vocabulary."""
    rows = with_lengths(records, count)
    scope = F.array(
        F.struct(F.lit("all").alias("scope"), F.lit("").alias("topic")),
        F.when(F.col("topic").isNotNull(), F.struct(F.lit("topic").alias("scope"), F.col("topic").alias("topic"))),
        F.when(F.col("topic").isin(*RECOGNITION), F.struct(F.lit("pooled").alias("scope"), F.lit("").alias("topic"))),
    )
    by = rows.withColumn("s", F.explode(F.array_compact(scope))).withColumns({"scope": F.col("s.scope"), "topic": F.col("s.topic")})
    acc = by.groupBy("scope", "topic").agg(F.count("*").alias("n"), rate(F.col("correct")).alias("accuracy"))
    return acc.join(gains(by, "scope", "topic", lengths=count is not None, finite_only=True), ["scope", "topic"])


def inherited(teacher: DataFrame, after: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """One row: how often the student repeats the teacher's wrong answers, and how often it gets right what the base model repeated."""
    n = teacher.agg(F.count_if(~F.col("correct")).alias("n_t_wrong"))
    cols = ("sample_id", "answer", "correct", *FILE_ORDER)
    joined = three_way(teacher.select("sample_id", "answer", "correct"), after.select(*cols), None if base is None else base.select(*cols), "sample_id", FILE_ORDER)
    names = {"n": "n_t_wrong_with_student", "acc_given_wrong": "acc_s_on_t_wrong", "tei_rate": "tei_rate", "inherited": "n_s_matches_t_wrong_answer"}
    if base is not None:
        names |= {"base_inherited": "n_base_inherited", "escape_rate": "escape_rate", "escaped": "n_escaped"}
    return n.join(G.inheritance(joined).select(*[F.col(a).alias(b) for a, b in names.items()]))  # one row each


def yes_no(records: DataFrame) -> DataFrame:
    """One row of a binary question's figures. An answer counts as right where it equals the gold, as yes only where it is yes."""
    gold = F.coalesce(X.canonical(F.col("gold")), F.lit(""))
    c = confusion(F.col("answer") == "yes", gold == "yes")
    names = {"precision_yes": c["precision"], "recall_yes": c["recall"], "f1_yes": c["f1"], "yes_rate": c["yes_rate"], "grounded_yes": c["tp"], "hallucinated_yes": c["fp"], "tp": c["tp"], "fp": c["fp"], "fn": c["fn"], "tn": c["tn"]}
    return records.agg(F.count("*").alias("n_samples"), rate(F.col("answer") == gold).alias("accuracy"), *[v.alias(k) for k, v in names.items()])


def parsed(text: Column, kind: Column, choices: Column) -> Column:
    """Whether a response has an answer: of several choices one named or a letter, else any text that isn't blank."""
    named = F.transform(choices, lambda c: X.strip(c))
    return (X.strip(text) != "") & F.when(F.coalesce(kind, F.lit("")) == "multi_choice", X.choice_parsed(text, named)).otherwise(True)


def free_answers(records: DataFrame) -> DataFrame:
    size = F.length("text")
    return records.agg(
        F.count("*").alias("n_samples"), rate(F.col("correct")).alias("accuracy"), percentile(size, 50).alias("response_length_p50"), percentile(size, 95).alias("response_length_p95"),
        F.avg(size).alias("response_length_mean"), rate(parsed(F.col("text"), F.col("question_type"), F.col("choices"))).alias("parse_success_rate"),
    )


def evaluate(after: DataFrame, teacher: DataFrame, pope: DataFrame, mathvista: DataFrame, base: DataFrame | None = None, count: Callable[[str], int] | None = None) -> dict:
    """All figures of a trained model as one nested document; only aggregates reach the driver."""
    rows = [r.asDict() for r in recognition(after, count).collect()]
    strip = lambda r: {k: v for k, v in r.items() if k not in ("scope", "topic")}
    scopes = {s: [r for r in rows if r["scope"] == s] for s in ("all", "topic", "pooled")}
    blank = {"n": 0, "accuracy": None, "n_gt": 0, "n_bias": 0, "mean_gain_ground_truth": None, "mean_gain_expected_bias": None, "gain_margin": None}
    whole = scopes["all"][0] if scopes["all"] else blank
    one = lambda df: df.first().asDict()
    yes, free, tei = one(yes_no(pope)), one(free_answers(mathvista)), one(inherited(teacher, after, base))
    return {
        "vlmbias": {
            "n_samples": whole["n"],
            "global_accuracy": whole["accuracy"],
            "per_topic": {r["topic"]: strip(r) for r in sorted(scopes["topic"], key=lambda r: r["topic"])},
            "recognition_aggregate": strip(scopes["pooled"][0]) if scopes["pooled"] else blank,
        },
        "tei": tei,
        "pope": yes,
        "mathvista": free,
        "_counts": {"vlmbias_student_after": whole["n"], "vlmbias_teacher": teacher.count(), "vlmbias_student_base": base.count() if base is not None else 0, "pope_student_after": yes["n_samples"], "mathvista_student_after": free["n_samples"]},
    }


def self_test(teacher: DataFrame, student: DataFrame, band: tuple[float, float] = (0.60, 0.64)) -> dict[str, bool]:
    """Checks of the metrics on recorded runs: a model that is its own base escapes nothing, and inherits at a rate within the band."""
    row = inherited(teacher, student, student).first()
    return {"tei_rate": row.tei_rate is not None and band[0] <= row.tei_rate <= band[1], "escape_rate": row.escape_rate in (0.0, None)}


def produce(samples: DataFrame, fn: Callable[[dict], dict], schema: str, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Records of a model: fn makes a record of a sample. Where it raises, the record has the sample's keys and the error.

    Partitions take the place of shards; a lost executor's samples are produced again.
    """
    names, make = [f.split()[0] for f in _names(schema)], telling_errors(fn, keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [make(row) for row in part.to_dict("records")]
            yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names, dtype=object)

    return samples.mapInPandas(run, schema)


def telling_errors(fn: Callable[[dict], dict], keys: tuple[str, ...] = ("sample_id",)) -> Callable[[dict], dict]:
    """fn, but where it raises, the record has the sample's keys and the error."""

    def make(row: dict) -> dict:
        try:
            return {"error": None} | fn(row)
        except Exception as e:  # a sample that fails is told in its record
            return {k: row[k] for k in keys} | {"error": f"{type(e).__name__}: {e}"}

    return make


def produce_resumably(samples: DataFrame, fn: Callable[[dict], dict], path: str, keys: tuple[str, ...] = ("sample_id",), flush: int = 1) -> int:
    """Append the records of samples to path, flushing as they are made; a run after one that died makes only what that one left.

    Samples are told by the first key. Failed samples have a record with the error, and count as done. The number of runs that had died.
    """
    return append_jsonl(samples, path, keys[0], telling_errors(fn, keys), flush, samples.sparkSession.sparkContext.defaultParallelism)


def _names(schema: str) -> list[str]:
    from siftwell.sources.records import _fields

    return [f.strip() for f in _fields(schema)]
