"""Queries of joins, aggregates, windows, sampling, gates and extension points."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import arrays as A
from siftwell.functions import stats as S
from siftwell.functions import text as X
from siftwell.operators import aggregates as G
from siftwell.operators import joins as J
from siftwell.operators import projections as R
from siftwell.operators import sampling as P
from siftwell.operators import sets
from siftwell.operators import windows as W
from siftwell.operators.hamming import hamming_pairs
from siftwell.operators.nearest import cosine_top1
from siftwell.plans import gates, generators, pluggable
from siftwell.plans import tokens as T
from siftwell.queries.base import ANN, LOG, REC, SERIES, TOK, query, run
from siftwell.queries.rows import SER, _series
from siftwell.sources.records import Registry
from siftwell.sources.sinks import pivot_steps
from siftwell.streaming.logs import last_by_step, log_series, windowed_counts

#: The last of a repeated student row: each document answered twice, the later counts.
LAST = "SELECT *, 1 AS o FROM ({0})"


def _rec(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, REC)


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Teacher, student (each row twice, the later one valid) and base (two rows of three)."""
    rows = _rec(spark, sf)
    teacher = rows.select("sample_id", "topic", "answer", "correct", "gold")
    late = rows.where("doc_id % 10 <> 0").select("sample_id", F.col("s_answer").alias("answer"), F.col("s_correct").alias("correct"), F.lit(1).alias("o"))
    early = late.select("sample_id", F.lit("early").alias("answer"), F.lit(False).alias("correct"), F.lit(0).alias("o"))
    base = rows.where("doc_id % 3 <> 0").select("sample_id", F.col("b_answer").alias("answer"), F.col("b_correct").alias("correct"), F.lit(0).alias("o"))
    return teacher, late.unionByName(early), base


def _three(spark: SparkSession, sf: str) -> DataFrame:
    return J.three_way(*_sides(spark, sf), "sample_id", ["o"])


@query("JON01", "SELECT sample_id, answer, s_answer FROM rec WHERE doc_id % 10 <> 0", rec=REC)
def jon01(spark: SparkSession, sf: str) -> DataFrame:
    teacher, student, _ = _sides(spark, sf)
    return J.teacher_student(teacher, student, "sample_id", ["o"]).select("sample_id", "answer", "s_answer")


@query("JON02", "SELECT sample_id, s_answer, CASE WHEN doc_id % 3 <> 0 THEN b_answer END AS b_answer FROM rec WHERE doc_id % 10 <> 0 AND NOT correct", rec=REC)
def jon02(spark: SparkSession, sf: str) -> DataFrame:
    return _three(spark, sf).where(~F.col("correct")).select("sample_id", "s_answer", "b_answer")


def _train_eval(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    train = run(spark, sf, "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 50 END AS image_id, source FROM documents")
    return train, run(spark, sf, "SELECT doc_id % 50 AS image_id FROM labels WHERE doc_id % 50 < 20")


_SEEN = "SELECT doc_id FROM documents WHERE {0} (doc_id % 9 <> 0 AND doc_id % 50 IN (SELECT doc_id % 50 FROM labels WHERE doc_id % 50 < 20))"


@query("JON03", _SEEN.format(""))
def jon03(spark: SparkSession, sf: str) -> DataFrame:
    return J.seen_ids(*_train_eval(spark, sf)).select("doc_id")


@query("JON04", _SEEN.format("NOT"))
def jon04(spark: SparkSession, sf: str) -> DataFrame:
    return J.unseen_ids(*_train_eval(spark, sf)).select("doc_id")


@query("JON05", _SEEN.format("NOT").replace("(doc_id % 9", "(source = 'src1' AND doc_id % 9"))
def jon05(spark: SparkSession, sf: str) -> DataFrame:
    train, ids = _train_eval(spark, sf)
    return J.drop_seen_if(train, ids, F.col("source") == "src1").select("doc_id")


#: 64-bit hashes with planted near pairs: groups of eight documents share a hash but for a few bits.
HASHES = "SELECT doc_id, xor((doc_id // 8 * 2654435761 % 4294967296) * 2147483647 + doc_id // 8, CASE doc_id % 8 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7340032 WHEN 4 THEN 1126999418470400 WHEN 5 THEN 5629499534213125 WHEN 6 THEN 31 ELSE 0 END) AS h FROM documents"


@query("JON06", "SELECT a.doc_id AS lid, b.doc_id AS rid, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance FROM (FROM h WHERE doc_id % 2 = 0) a JOIN (FROM h WHERE doc_id % 2 = 1) b ON bit_count(xor(a.h, b.h)) < 5", h=HASHES)
def jon06(spark: SparkSession, sf: str) -> DataFrame:
    own = HASHES.replace("doc_id // 8", "doc_id DIV 8").replace("xor((", "((").replace(" + doc_id DIV 8, CASE", " + doc_id DIV 8) ^ (CASE")
    h = run(spark, sf, own)
    return hamming_pairs(h.where("doc_id % 2 = 0").select(F.col("doc_id").alias("lid"), "h"), h.where("doc_id % 2 = 1").select(F.col("doc_id").alias("rid"), "h"))


@query("JON07", "SELECT tid, max_by(eid, s) AS eid, round(max(s), 5) AS similarity FROM (SELECT t.vec_id AS tid, e.vec_id AS eid, list_cosine_similarity(t.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings t, embeddings e WHERE t.vec_id % 5 <> 0 AND e.vec_id % 5 = 0) WHERE s > 0.3 GROUP BY tid")
def jon07(spark: SparkSession, sf: str) -> DataFrame:
    v = run(spark, sf, "SELECT vec_id, embedding FROM embeddings")
    train = v.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("tid"), F.col("embedding").alias("v"))
    evals = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("eid"), F.col("embedding").alias("v"))
    return cosine_top1(train, evals, threshold=0.3).withColumn("similarity", F.round("similarity", 5))


@query("JON08", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN doc_id % 4 <> 0 THEN 'found' ELSE '' END AS path FROM documents")
def jon08(spark: SparkSession, sf: str) -> DataFrame:
    docs = run(spark, sf, "SELECT doc_id FROM documents")
    rows = docs.withColumn("image_paths", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("own"))))
    found = J.with_lookup(rows, docs.where("doc_id % 4 <> 0").withColumn("paths", F.array(F.lit("found"))), "doc_id", "image_paths", "paths")
    return found.select("doc_id", F.coalesce(F.get("image_paths", F.lit(0)), F.lit("")).alias("path"))


@query("JON09", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def jon09(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = run(spark, sf, "SELECT c_custkey, c_nationkey FROM customer"), run(spark, sf, "SELECT * FROM nation")
    return J.name_lookup(rows, names, "c_nationkey", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("JON10", "SELECT a.cat AS a, b.cat AS b, count(*) AS n FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.cat <> b.cat GROUP BY ALL", ann=ANN)
def jon10(spark: SparkSession, sf: str) -> DataFrame:
    rows = run(spark, sf, "SELECT l_orderkey AS image_id, p_brand AS cat FROM lineitem JOIN part ON l_partkey = p_partkey")
    return J.cooccurrence(rows, "image_id", "cat")


@query("JON12", "SELECT topic, count(*) FILTER (NOT correct AND NOT s_correct) AS both_wrong, count(*) FILTER (NOT correct AND NOT s_correct AND answer = s_answer) AS same_wrong FROM rec WHERE doc_id % 10 <> 0 GROUP BY topic", rec=REC)
def jon12(spark: SparkSession, sf: str) -> DataFrame:
    teacher, student, _ = _sides(spark, sf)
    return G.error_overlap(J.teacher_student(teacher, student, "sample_id", ["o"]), "topic").select("topic", "both_wrong", "same_wrong")


@query("JON13", "SELECT count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 = 0)")
def jon13(spark: SparkSession, sf: str) -> DataFrame:
    docs = run(spark, sf, "SELECT doc_id FROM documents")
    return J.overlap_of(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 7 = 0"), "doc_id").agg(F.count("*").alias("n"))


# --- aggregates


@query("AGG01", "SELECT topic, round(avg(bias_i), 6) AS m FROM rec GROUP BY topic", rec=REC)
def agg01(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_rec(spark, sf).groupBy("topic").agg(F.avg("bias_i").alias("m")), "m")


@query("AGG02", "SELECT topic, round(avg(gt_i) FILTER (doc_id % 3 = 0), 6) AS m FROM rec GROUP BY topic", rec=REC)
def agg02(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when(F.col("doc_id") % 3 == 1, F.lit(float("nan"))).when(F.col("doc_id") % 3 == 2, F.lit(float("inf"))).otherwise(F.col("gt_i"))
    return _round(_rec(spark, sf).groupBy("topic").agg(S.finite_mean(odd).alias("m")), "m")


_ACC = "count(*) AS n, round(avg(correct_i::INT), 6) AS acc_i, round(avg(correct_null::INT), 6) AS acc_null"


@query("AGG03", f"SELECT {_ACC}, round(avg(correct_i::INT) - avg(correct_null::INT), 6) AS delta_acc FROM rec", rec=REC)
def agg03(spark: SparkSession, sf: str) -> DataFrame:
    return _round(G.accuracy(_rec(spark, sf)), "acc_i", "acc_null", "delta_acc")


_SPLIT = "count(*) FILTER (correct_i) AS n_correct, count(*) FILTER (NOT correct_i) AS n_wrong, round(avg(mean_delta) FILTER (correct_i), 6) AS mean_correct, round(avg(mean_delta) FILTER (NOT correct_i), 6) AS mean_wrong, round(avg(mean_delta) FILTER (correct_i) - avg(mean_delta) FILTER (NOT correct_i), 6) AS gap"


@query("AGG05", f"SELECT topic, {_SPLIT} FROM rec GROUP BY topic", rec=REC)
def agg05(spark: SparkSession, sf: str) -> DataFrame:
    return _round(G.split_means(_rec(spark, sf), "mean_delta", "correct_i", "topic"), "mean_correct", "mean_wrong", "gap")


_RANKS = "SELECT topic, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT l_returnflag AS topic, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem) GROUP BY topic"


@query("AGG06", _RANKS)
def agg06(spark: SparkSession, sf: str) -> DataFrame:
    rows = run(spark, sf, "SELECT l_returnflag AS topic, l_quantity, l_extendedprice FROM lineitem")
    return _round(S.spearman(rows, "l_quantity", "l_extendedprice", ["topic"]), "rho")


def _options(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda a, b: F.map_filter(F.create_map(F.lit("ground_truth"), F.col(a), F.lit("expected_bias"), F.col(b)), lambda k, v: v.isNotNull())
    return _rec(spark, sf).select("topic", "doc_id", pair("gt_i", "bias_i").alias("opt_i"), pair("gt_null", "bias_null").alias("opt_null"))


_GAIN = "count(gt_i) AS n_gt, count(bias_i) AS n_bias, round(avg(gt_i - gt_null), 6) AS gain_gt, round(avg(bias_i - bias_null), 6) AS gain_bias, round(avg(gt_i - gt_null) - avg(bias_i - bias_null), 6) AS margin"


@query("AGG07", f"SELECT topic, {_GAIN}, CAST(0 AS BIGINT) AS n_skipped, round(avg((gt_i - gt_null) / 2), 6) AS gain_gt_per_token, round(avg((bias_i - bias_null) / 4), 6) AS gain_bias_per_token, round(avg((gt_i - gt_null) / 2) - avg((bias_i - bias_null) / 4), 6) AS margin_per_token FROM rec GROUP BY topic", rec=REC)
def agg07(spark: SparkSession, sf: str) -> DataFrame:
    rows = _options(spark, sf).withColumns({"len_gt": F.lit(2), "len_bias": F.lit(4)})
    out = G.visual_gain(rows, "topic", lengths=("len_gt", "len_bias"))
    return _round(out, "gain_gt", "gain_bias", "margin", "gain_gt_per_token", "gain_bias_per_token", "margin_per_token")


@query("AGG08", f"SELECT {_GAIN} FROM rec", rec=REC)
def agg08(spark: SparkSession, sf: str) -> DataFrame:
    return _round(G.visual_gain(_options(spark, sf), finite_only=True), "gain_gt", "gain_bias", "margin").drop("n_skipped")


@query("AGG09", "SELECT *, round(same_wrong / both_wrong, 6) AS same_rate, round(1 / (answer_space - 1), 6) AS chance, round(same_wrong / both_wrong - 1 / (answer_space - 1), 6) AS excess FROM (SELECT count(*) AS n_matched, count(*) FILTER (NOT correct AND NOT s_correct) AS both_wrong, count(*) FILTER (NOT correct AND NOT s_correct AND answer = s_answer) AS same_wrong, count(DISTINCT gold) AS answer_space FROM rec WHERE doc_id % 10 <> 0)", rec=REC)
def agg09(spark: SparkSession, sf: str) -> DataFrame:
    teacher, student, _ = _sides(spark, sf)
    return _round(G.error_overlap(J.teacher_student(teacher, student, "sample_id", ["o"])), "same_rate", "chance", "excess")


@query("AGG10", "SELECT count(*) FILTER (y AND g) AS n_grounded, count(*) FILTER (y AND NOT g) AS n_hallucinated, round(avg(mean_delta) FILTER (y AND g), 6) AS grounded, round(avg(mean_delta) FILTER (y AND NOT g), 6) AS hallucinated, round(avg(mean_delta) FILTER (y AND g) - avg(mean_delta) FILTER (y AND NOT g), 6) AS gap FROM (SELECT mean_delta, doc_id % 3 <> 0 AS y, doc_id % 2 = 0 AS g FROM rec)", rec=REC)
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = _rec(spark, sf).select("mean_delta", F.when(d % 3 != 0, "Yes it is").otherwise("none").alias("answer"), F.when(d % 2 == 0, "yes").otherwise("no").alias("gold"))
    return _round(G.grounding_gap(rows, "mean_delta"), "grounded", "hallucinated", "gap")


@query("AGG11", f"SELECT dataset, {_ACC} FROM rec GROUP BY dataset", rec=REC)
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    return _round(G.accuracy(_rec(spark, sf), "dataset"), "acc_i", "acc_null").drop("delta_acc")


@query("AGG12", f"SELECT topic, {_ACC} FROM rec WHERE topic <> 'es' GROUP BY topic", rec=REC)
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf).withColumn("topic", F.when(F.col("topic") != "es", F.col("topic"))).where("topic IS NOT NULL")
    return _round(G.accuracy(rows, "topic"), "acc_i", "acc_null").drop("delta_acc")


@query("AGG13", f"SELECT 'all' AS scope, '' AS grp, {_ACC} FROM rec UNION ALL SELECT 'group', topic, {_ACC} FROM rec GROUP BY topic UNION ALL SELECT 'pooled', '', {_ACC} FROM rec WHERE topic IN ('en', 'de')", rec=REC)
def agg13(spark: SparkSession, sf: str) -> DataFrame:
    out = G.with_totals(_rec(spark, sf), "topic", F.col("topic").isin("en", "de"))
    return _round(out, "acc_i", "acc_null").withColumn("grp", F.coalesce("grp", F.lit("")))


@query("AGG14", "SELECT *, round(inherited / n, 6) AS tei_rate, round(escaped / base_inherited, 6) AS escape_rate FROM (SELECT topic, count(*) AS n, round(avg(s_correct::INT), 6) AS acc_given_wrong, count(*) FILTER (s_answer = answer AND s_answer <> '') AS inherited, count(*) FILTER (b) AS base_inherited, count(*) FILTER (b AND s_correct) AS escaped FROM (SELECT *, doc_id % 3 <> 0 AND b_answer = answer AND NOT b_correct AS b FROM rec WHERE doc_id % 10 <> 0 AND NOT correct) GROUP BY topic)", rec=REC)
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    return _round(G.inheritance(_three(spark, sf), "topic"), "acc_given_wrong", "tei_rate", "escape_rate")


_CONF = "round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + fp) / n, 6) AS yes_rate"


@query("AGG15", f"SELECT tp, fp, fn, tn, {_CONF} FROM (SELECT count(*) AS n, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn FROM (SELECT quality = 1 AS p, toxic = 0 AS g FROM labels))")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    rows = run(spark, sf, "SELECT quality, toxic FROM labels")
    return _round(G.binary_confusion(rows, F.col("quality") == 1, F.col("toxic") == 0), "accuracy", "precision", "recall", "f1", "yes_rate")


@query("AGG16", "SELECT source, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY source")
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.percentiles(run(spark, sf, "SELECT source, n_chars FROM documents"), "n_chars", ["source"], {"p95": 95}), "p95")


@query("AGG17", "SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean_len, quantile_cont(length(text)::DOUBLE, 0.5) AS p50, round(quantile_cont(length(text)::DOUBLE, 0.95), 6) AS p95, round(avg((turn % 2 = 0)::INT), 6) AS parse_rate FROM conversations GROUP BY role")
def agg17(spark: SparkSession, sf: str) -> DataFrame:
    return _round(G.length_stats(run(spark, sf, "SELECT role, turn, text FROM conversations"), "text", F.col("turn") % 2 == 0, "role"), "mean_len", "p95", "parse_rate")


_LAST = f"SELECT * FROM ({SERIES}) QUALIFY row_number() OVER (PARTITION BY step, metric ORDER BY line_no DESC) = 1"


@query("AGG18", "SELECT metric, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, max_by(value, step) AS last, count(*) AS n FROM s GROUP BY metric", s=f"SELECT * FROM ({_LAST}) WHERE metric <> 'actor/grad_norm'")
def agg18(spark: SparkSession, sf: str) -> DataFrame:
    series = last_by_step(log_series(run(spark, sf, LOG))).where("metric <> 'actor/grad_norm'")
    return _round(G.metric_ranges(series), "mean")


@query("AGG19", "SELECT topic, count(*) AS n, round(avg(correct::INT), 6) AS acc, round(avg(correct::INT) FILTER (is_counterfactual), 6) AS acc_cf, round(avg(correct::INT) FILTER (NOT is_counterfactual), 6) AS acc_canonical, round(count(*) FILTER (is_counterfactual AND NOT correct AND answer = prior) / count(*) FILTER (is_counterfactual AND NOT correct), 6) AS prior_rate FROM rec GROUP BY topic", rec=REC)
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    return _round(G.conditional_rates(_rec(spark, sf), "topic"), "acc", "acc_cf", "acc_canonical", "prior_rate")


@query("AGG20", "SELECT count(*) AS n, count(*) FILTER (answer = '2') AS n_two, count(*) FILTER (answer = gold) AS n_equal FROM rec WHERE topic = 'en'", rec=REC)
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    return G.rates_of(_rec(spark, sf).where("topic = 'en'"), [("n_two", F.col("answer") == "2"), ("n_equal", F.col("answer") == F.col("gold"))])


@query("AGG21", "SELECT p_brand AS cat, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    return G.count_by(run(spark, sf, "SELECT p_brand AS cat FROM lineitem JOIN part ON l_partkey = p_partkey"), "cat")


@query("AGG22", "SELECT image_id, list_sort(list(cat)) AS cats FROM ann GROUP BY image_id", ann=ANN)
def agg22(spark: SparkSession, sf: str) -> DataFrame:
    rows = run(spark, sf, "SELECT l_orderkey AS image_id, p_brand AS cat FROM lineitem JOIN part ON l_partkey = p_partkey")
    return rows.groupBy("image_id").agg(F.sort_array(F.collect_set("cat")).alias("cats"))


@query("AGG23", "SELECT topic, source, count(*) AS n FROM rec GROUP BY ALL", rec=REC)
def agg23(spark: SparkSession, sf: str) -> DataFrame:
    return G.count_by(_rec(spark, sf), "topic", "source")


_SUMS = "count(*) FILTER (mask AND coalesce(loss_branch, 'kl') <> 'ce') AS kl_tokens, count(*) FILTER (mask AND loss_branch = 'ce') AS ce_tokens, count(DISTINCT CASE WHEN loss_branch = 'ce' THEN sample_id END) AS ce_samples, coalesce(sum(raw_kl) FILTER (mask AND coalesce(loss_branch, 'kl') <> 'ce'), 0) AS k, coalesce(sum(-log_prob * coalesce(beta, 0.1)) FILTER (mask AND loss_branch = 'ce'), 0) AS c"
_SUMMED = "kl_tokens, ce_tokens, ce_samples, round(k, 4) AS kl_sum, round(c, 4) AS ce_sum, round(CASE WHEN abs(k + c) <= 1e-12 THEN 0 ELSE k / (k + c) END, 6) AS kl_ce_ratio"


def _sums(df: DataFrame) -> DataFrame:
    return df.withColumns({"kl_sum": F.round("kl_sum", 4), "ce_sum": F.round("ce_sum", 4), "kl_ce_ratio": F.round("kl_ce_ratio", 6)})


@query("AGG24", f"SELECT batch_id, {_SUMMED} FROM (SELECT batch_id, {_SUMS} FROM tok GROUP BY batch_id)", tok=TOK)
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    return _sums(G.batch_sums(run(spark, sf, TOK).withColumn("weight", F.lit(None).cast("double")), "batch_id"))


@query("AGG25", f"SELECT bucket, {_SUMMED}, teacher_correct FROM (SELECT coalesce(bucket, 'unknown') AS bucket, {_SUMS}, round(avg(coalesce(trajectory_pass, true)::INT) FILTER (mask), 6) AS teacher_correct FROM tok GROUP BY ALL)", tok=TOK)
def agg25(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_sums(G.bucket_sums(run(spark, sf, TOK).withColumn("weight", F.lit(1.0)))), "teacher_correct")


@query("AGG26", "SELECT batch_id, count(delta) AS n, round(avg(delta), 6) AS mean, round(var_samp(delta), 6) AS variance FROM tok GROUP BY batch_id", tok=TOK)
def agg26(spark: SparkSession, sf: str) -> DataFrame:
    return _round(G.weight_moments(run(spark, sf, TOK), "delta", "batch_id"), "mean", "variance")


@query("AGG27", "SELECT bin, n, round(n / (sum(n) OVER () / 49), 6) AS density FROM (SELECT CAST(least(floor(mean_delta * 49) + 1, 49) AS BIGINT) AS bin, count(*) AS n FROM rec GROUP BY 1)", rec=REC)
def agg27(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.histogram(_rec(spark, sf), "mean_delta", 0.0, 1.0, 49), "density")


@query("AGG28", "SELECT topic, count(*) AS n, round(avg(gt_i - gt_null) - avg(bias_i - bias_null), 6) AS margin FROM rec WHERE bias_i IS NOT NULL GROUP BY topic", rec=REC)
def agg28(spark: SparkSession, sf: str) -> DataFrame:
    return _round(G.paired_margin(_options(spark, sf), "topic").select("topic", F.col("n_gt").alias("n"), "margin"), "margin")


@query("AGG29", "SELECT count(*) AS done, round(avg((event_type = 'click')::INT), 6) AS pass_rate, round(count(*) / s, 9) AS per_second, round((20000 - count(*)) * s / count(*), 3) AS seconds_left FROM events, (SELECT epoch(max(ts)) - epoch(min(ts)) AS s FROM events) GROUP BY s")
def agg29(spark: SparkSession, sf: str) -> DataFrame:
    out = G.run_progress(run(spark, sf, "SELECT CAST(ts AS TIMESTAMP) AS ts, event_type FROM events"), F.col("event_type") == "click", F.col("ts"), F.col("ts"), 20000)
    return out.select("done", F.round("pass_rate", 6).alias("pass_rate"), F.round("per_second", 9).alias("per_second"), F.round("seconds_left", 3).alias("seconds_left"))


@query("AGG30", "SELECT count(*) AS n FROM documents")
def agg30(spark: SparkSession, sf: str) -> DataFrame:
    from siftwell.operators.sets import concat_all

    docs = run(spark, sf, "SELECT doc_id FROM documents")
    return concat_all(*[docs.where(F.col("doc_id") % 4 == k) for k in range(4)]).agg(F.count("*").alias("n"))


# --- windows


@query("WIN01", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2 AS r FROM (SELECT event_id, event_type, floor(value) AS v FROM events)")
def win01(spark: SparkSession, sf: str) -> DataFrame:
    rows = run(spark, sf, "SELECT event_id, event_type, floor(value) AS v FROM events")
    return S.with_ranks(rows, "v", ["event_type"], "r").select("event_id", "r")


@query("WIN02", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def win02(spark: SparkSession, sf: str) -> DataFrame:
    return W.keep_last(run(spark, sf, "SELECT user_id, event_id, event_type, ts FROM events"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("WIN03", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def win03(spark: SparkSession, sf: str) -> DataFrame:
    return W.keep_first(run(spark, sf, "SELECT text, doc_id FROM documents"), ["text"], ["doc_id"])


@query("WIN04", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 20")
def win04(spark: SparkSession, sf: str) -> DataFrame:
    return W.stratum_head(run(spark, sf, "SELECT doc_id, lang FROM documents"), "lang", "doc_id", F.lit(20))


@query("WIN05", "SELECT doc_id, CAST(list_position(a, list_max(a)) - 1 AS BIGINT) AS at FROM ser", ser=SER)
def win05(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).select("doc_id", A.first_argmax(F.col("a")).cast("bigint").alias("at"))


@query("WIN06", "SELECT sample_id, t, round(least(delta, quantile_cont(delta, 0.95) OVER (PARTITION BY batch_id)), 6) AS clipped FROM tok", tok=TOK)
def win06(spark: SparkSession, sf: str) -> DataFrame:
    return _round(W.clip_at_quantile(run(spark, sf, TOK), "delta", "batch_id").select("sample_id", "t", "clipped"), "clipped")


@query("WIN07", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 8 AS BIGINT) AS shard FROM documents")
def win07(spark: SparkSession, sf: str) -> DataFrame:
    return W.round_robin(run(spark, sf, "SELECT doc_id FROM documents"), 8, "doc_id").withColumn("shard", F.col("shard").cast("bigint"))


# --- top-k and sampling


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).select("doc_id", F.col("a").alias("deltas"), F.transform("b", lambda x, i: F.concat(F.lit("t"), i.cast("string"))).alias("tokens"), (F.col("doc_id") % 4).alias("topic"))


TOKENS = "SELECT doc_id, doc_id % 4 AS topic, i - 1 AS pos, 't' || (i - 1) AS token, a[i] AS value FROM ser, unnest(range(1, least(len(a), len(b)) + 1)) AS u(i)"


@query("TOP01", "SELECT doc_id, CASE WHEN p <= len(b) THEN 't' || (p - 1) ELSE '-' END AS token, value FROM (SELECT doc_id, b, list_max(a) AS value, list_position(a, list_max(a)) AS p FROM ser) ORDER BY value DESC, doc_id LIMIT 50", ser=SER)
def top01(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_tokens_by_sample(_tokens(spark, sf), "doc_id", 50).withColumn("token", F.coalesce("token", F.lit("-")))


@query("TOP02", f"SELECT doc_id, pos, token, value FROM ({TOKENS}) ORDER BY value DESC, doc_id, pos LIMIT 100", ser=SER)
def top02(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_tokens(_tokens(spark, sf), "doc_id", 100)


@query("TOP03", f"SELECT topic, doc_id, pos, token, value FROM ({TOKENS}) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY value DESC, doc_id, pos) <= 20", ser=SER)
def top03(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.explode_tokens(_tokens(spark, sf), "topic", "doc_id")
    return P.top_per_group(rows, "topic", [F.desc("value"), F.col("doc_id"), F.col("pos")], 20)


@query("TOP04", "SELECT topic, margin, row_number() OVER (ORDER BY margin DESC, topic) AS rank FROM (SELECT topic, round(coalesce(avg(gt_i - gt_null) - avg(bias_i - bias_null), 0), 6) AS margin FROM rec GROUP BY topic)", rec=REC)
def top04(spark: SparkSession, sf: str) -> DataFrame:
    gains = _round(G.visual_gain(_options(spark, sf), "topic").select("topic", F.coalesce("margin", F.lit(0.0)).alias("margin")), "margin")
    return P.rank_by(gains, F.desc("margin"), F.col("topic")).withColumn("rank", F.col("rank").cast("bigint"))


@query("TOP05", "SELECT topic, excess, row_number() OVER (ORDER BY excess DESC, topic) AS rank FROM (SELECT topic, round(count(*) FILTER (NOT correct AND NOT s_correct AND answer = s_answer) / count(*) FILTER (NOT correct AND NOT s_correct) - 1 / (count(DISTINCT gold) - 1), 6) AS excess FROM rec WHERE doc_id % 10 <> 0 GROUP BY topic)", rec=REC)
def top05(spark: SparkSession, sf: str) -> DataFrame:
    teacher, student, _ = _sides(spark, sf)
    over = _round(G.error_overlap(J.teacher_student(teacher, student, "sample_id", ["o"]), "topic").select("topic", "excess"), "excess")
    return P.rank_by(over, F.desc("excess"), F.col("topic")).withColumn("rank", F.col("rank").cast("bigint"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.count_by(run(spark, sf, "SELECT p_type AS cat FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type LIKE '%N%'"), "cat")


@query("TOP06", "SELECT cat, n, row_number() OVER (ORDER BY n DESC, cat) AS rank FROM (SELECT p.cat, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_type AS cat FROM part) p LEFT JOIN (SELECT p_type AS cat, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type LIKE '%N%' GROUP BY 1) c ON p.cat = c.cat)")
def top06(spark: SparkSession, sf: str) -> DataFrame:
    return P.popularity(_counts(spark, sf), run(spark, sf, "SELECT DISTINCT p_type AS cat FROM part")).withColumn("rank", F.col("rank").cast("bigint"))


_CO = "SELECT a.cat AS a, b.cat AS b, count(*) AS n FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.cat <> b.cat GROUP BY ALL"


@query("TOP07", f"SELECT a, list(b ORDER BY n DESC, b) AS ranked FROM ({_CO}) GROUP BY a", ann=ANN)
def top07(spark: SparkSession, sf: str) -> DataFrame:
    return P.cooccurrence_ranking(jon10(spark, sf))


@query("TOP08", "SELECT doc_id, list_reverse_sort(a)[1:3] AS top FROM ser", ser=SER)
def top08(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).select("doc_id", A.top_k(F.col("a"), 3).alias("top"))


@query("TOP09", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def top09(spark: SparkSession, sf: str) -> DataFrame:
    return P.head(run(spark, sf, "SELECT doc_id, n_chars FROM documents"), 25, "doc_id")


@query("TOP10", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 30")
def top10(spark: SparkSession, sf: str) -> DataFrame:
    return P.shuffled_head(run(spark, sf, "SELECT doc_id FROM documents"), "doc_id", 30)


_SIZES = "SELECT lang, count(*) AS s, min(doc_id) AS f FROM documents GROUP BY lang"


#: Quotas in closed form: proportional and half-even, one round of slack in order of first appearance, excess off the largest.
_TOP11 = """
WITH d AS (SELECT doc_id, coalesce(lang, 'UNKNOWN') AS lang FROM documents),
s AS (SELECT lang, count(*) AS size, min(doc_id) AS first_id FROM d GROUP BY lang),
q AS (SELECT *, least(CAST(round_even(101.0E0 * size / sum(size) OVER (), 0) AS BIGINT), size) AS q FROM s),
o AS (SELECT *, greatest(0, 101 - sum(q) OVER ()) AS slack, greatest(0, sum(q) OVER () - 101) AS excess,
  count(*) FILTER (q < size) OVER () AS n_open, count(*) FILTER (q < size) OVER (ORDER BY first_id) AS nth_open FROM q),
g AS (SELECT *, CASE WHEN q < size THEN least(size, q + slack // n_open + CASE WHEN nth_open <= slack % n_open THEN 1 ELSE 0 END) ELSE q END AS grown FROM o),
r AS (SELECT lang, grown - CASE WHEN row_number() OVER (ORDER BY grown DESC, first_id) = 1 THEN excess ELSE 0 END AS quota FROM g)
SELECT doc_id, lang FROM d JOIN r USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= quota
"""


@query("TOP11", _TOP11)
def top11(spark: SparkSession, sf: str) -> DataFrame:
    return P.stratified_sample(run(spark, sf, "SELECT doc_id, lang FROM documents"), "lang", "doc_id", 101)


_TOP12 = "SELECT source AS topic, sum(n_chars)::DOUBLE AS w FROM documents GROUP BY source"


@query("TOP12", f"WITH w AS ({_TOP12}), s AS (SELECT topic, CAST(round_even(1501 * w / sum(w) OVER (), 0) AS BIGINT) AS n, topic = max(topic) OVER () AS last FROM w) SELECT topic, CAST(CASE WHEN last THEN 1501 - (SELECT sum(n) FROM s WHERE NOT last) ELSE n END AS BIGINT) AS n FROM s")
def top12(spark: SparkSession, sf: str) -> DataFrame:
    """1501 samples over the sources by how much text they have."""
    weights = run(spark, sf, "SELECT source AS topic, n_chars FROM documents").select("topic", F.col("n_chars").cast("double").alias("weight"))
    return P.allocate_rows(weights, 1501)


def _images(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images with their categories, the pairs that they come from, and all categories."""
    ann = run(spark, sf, "SELECT l_orderkey AS image_id, p_brand AS cat FROM lineitem JOIN part ON l_partkey = p_partkey")
    return ann.groupBy("image_id").agg(F.sort_array(F.collect_set("cat")).alias("cats")), ann, ann.select("cat").distinct()


_HARD = f"SELECT s.image_id, list_filter(p.popular, lambda c: NOT list_contains(s.cats, c))[1] AS popular, coalesce(list_filter(r.ranked, lambda c: NOT list_contains(s.cats, c))[1], list_filter(p.popular, lambda c: NOT list_contains(s.cats, c))[1]) AS cooccur FROM (SELECT image_id, list_sort(list(cat)) AS cats FROM ann GROUP BY image_id) s CROSS JOIN (SELECT list(cat ORDER BY n DESC, cat) AS popular FROM (SELECT p_brand AS cat, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)) p LEFT JOIN (SELECT a, list(b ORDER BY n DESC, b) AS ranked FROM ({_CO}) GROUP BY a) r ON r.a = s.cats[1]"


_TOP13 = f"""
SELECT image_id, 'yes' AS gold, CAST(NULL AS VARCHAR) AS neg_type, (SELECT min_by(c, md5('42:' || CAST(image_id AS VARCHAR) || ':' || c)) FROM (SELECT unnest(cats) AS c)) AS category FROM chosen WHERE i < 40
UNION ALL SELECT image_id, 'no', kind, CASE kind WHEN 'popular' THEN popular WHEN 'cooccur' THEN cooccur ELSE coalesce(list_filter(list_transform(range(32),
  lambda k: ranked[('0x' || substr(md5('42:' || CAST(image_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 8))::BIGINT % len(ranked) + 1]), lambda c: NOT list_contains(cats, c))[1], popular) END
FROM (SELECT *, CASE WHEN i < 20 THEN 'random' WHEN i < 30 THEN 'popular' ELSE 'cooccur' END AS kind FROM chosen JOIN ({_HARD}) USING (image_id)
  CROSS JOIN (SELECT list(cat ORDER BY n DESC, cat) AS ranked FROM (SELECT p_brand AS cat, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1))) WHERE i < 40
"""
_CHOSEN = "SELECT image_id, list_sort(list(cat)) AS cats, row_number() OVER (ORDER BY md5('42:' || CAST(image_id AS VARCHAR)), image_id) - 1 AS i FROM ann GROUP BY image_id"


@query("TOP13", _TOP13, ann=ANN, chosen=_CHOSEN)
def top13(spark: SparkSession, sf: str) -> DataFrame:
    return P.quota_sampler(*_images(spark, sf), 40, {"random": 20, "popular": 10, "cooccur": 10})


@query("TOP14", _HARD, ann=ANN)
def top14(spark: SparkSession, sf: str) -> DataFrame:
    return P.negatives(*_images(spark, sf), ("popular", "cooccur")).drop("cats")


@query("TOP15", "SELECT metric, value FROM s WHERE step = (SELECT max(step) FROM s)", s=_LAST)
def top15(spark: SparkSession, sf: str) -> DataFrame:
    series = log_series(run(spark, sf, LOG)).where(S.finite(F.col("value")))
    return P.last_step(last_by_step(series)).select("metric", "value")


# --- gates


@query("GAT01", "SELECT n_met, CASE WHEN n_met >= 2 THEN 'GO' WHEN n_met = 1 THEN 'BORDERLINE' ELSE 'KILL' END AS verdict FROM (SELECT (avg(correct_i::INT) > avg(correct_null::INT))::INT + (avg(mean_delta) FILTER (correct_i) > avg(mean_delta) FILTER (NOT correct_i))::INT + (avg(gt_i - gt_null) > avg(bias_i - bias_null))::INT AS n_met FROM rec)", rec=REC)
def gat01(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf)
    one = G.accuracy(rows).select("delta_acc").join(G.split_means(rows, "mean_delta", "correct_i").select("gap")).join(G.visual_gain(_options(spark, sf)).select("margin"))  # one row each
    checks = {"c1": F.col("delta_acc") > 0, "c2": F.col("gap") > 0, "c3": F.col("margin") > 0}
    return gates.criteria_verdict(one, checks).select("n_met", "verdict")


@query("GAT02", "SELECT topic, CASE WHEN acc IS NULL THEN 'INCONCLUSIVE' WHEN acc >= 0.1 THEN 'FAIL too easy' WHEN p IS NULL OR p < 0.3 THEN 'FAIL weak prior' ELSE 'PASS' END AS verdict FROM (SELECT topic, avg(correct::INT) FILTER (is_counterfactual) AS acc, count(*) FILTER (is_counterfactual AND NOT correct AND answer = prior) / count(*) FILTER (is_counterfactual AND NOT correct) AS p FROM rec GROUP BY topic)", rec=REC)
def gat02(spark: SparkSession, sf: str) -> DataFrame:
    rates = G.conditional_rates(_rec(spark, sf), "topic")
    return rates.select("topic", gates.synth_verdict(F.col("acc_cf"), F.col("prior_rate"), easy=0.1).alias("verdict"))


@query("GAT03", "SELECT metric, value, CASE WHEN ok THEN 'ok' WHEN metric = 'perf/x' THEN 'warn' ELSE 'fail' END AS severity, ok FROM (SELECT metric, value, CASE metric WHEN 'actor/loss' THEN value < 100 WHEN 'perf/x' THEN value BETWEEN 5 AND 6 END AS ok FROM s WHERE step = (SELECT max(step) FROM s) AND metric IN ('actor/loss', 'perf/x'))", s=_LAST)
def gat03(spark: SparkSession, sf: str) -> DataFrame:
    rules = [*gates.HEALTH_RULES, ("perf/x", 5.0, 6.0, "warn", "D")]
    return gates.health_findings(last_by_step(log_series(run(spark, sf, LOG))), rules, "D")


@query("GAT04", "SELECT CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS BIGINT) AS code FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 = 0")
def gat04(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(gates.gate_code(jon13(spark, sf).first().n),)], "code bigint")


@query("GAT05", "SELECT CAST(0 AS BIGINT) AS escaped, count(*) > 0 AS some FROM rec WHERE NOT b_correct AND b_answer = answer AND NOT correct", rec=REC)
def gat05(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf).select("sample_id", "topic", "answer", "correct", "gold", F.col("b_answer").alias("s_answer"), F.col("b_correct").alias("s_correct"), "b_answer", "b_correct")
    return G.inheritance(rows).select("escaped", (F.col("base_inherited") > 0).alias("some"))


@query("GAT06", "SELECT 'after' AS config, topic, round(avg(s_correct::INT), 6) AS acc FROM rec GROUP BY topic UNION ALL SELECT 'base', topic, round(avg(b_correct::INT), 6) FROM rec GROUP BY topic", rec=REC)
def gat06(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf)
    by = lambda c: _round(rows.groupBy("topic").agg(S.rate(F.col(c)).alias("acc")), "acc")
    return gates.comparison({"after": by("s_correct"), "base": by("b_correct")})


@query("GAT07", "SELECT count(*) FILTER (doc_id % 10 = 0) AS n_failures, count(*) AS n_lines FROM documents")
def gat07(spark: SparkSession, sf: str) -> DataFrame:
    lines = run(spark, sf, "SELECT CASE WHEN doc_id % 10 = 0 THEN 'a RuntimeError: x' ELSE 'fine' END AS line FROM documents")
    return gates.failure_lines(lines, gates.FAILURE)


@query("GAT08", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'ce' ELSE 'kl' END AS branch, doc_id % 4 = 0 AS delta FROM documents")
def gat08(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    recipe = F.concat(F.when(d % 2 == 0, "filtered").otherwise("vanilla"), F.when(d % 4 == 0, "_delta").otherwise(""))
    right = F.when(d % 3 == 0, False).when(d % 3 == 1, True)
    return run(spark, sf, "SELECT doc_id FROM documents").select("doc_id", gates.branch(recipe, right).alias("branch"), gates.uses_delta(recipe).alias("delta"))


# --- extension points


@query("UDF01", "SELECT topic, count(*) AS n, CAST(sum(length(source)) AS BIGINT) AS total FROM rec GROUP BY topic", rec=REC)
def udf01(spark: SparkSession, sf: str) -> DataFrame:
    return pluggable.map_distinct(_rec(spark, sf), "source", len, "n_tokens").groupBy("topic").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("total"))


@query("UDF02", "SELECT source AS name, CASE WHEN source LIKE '%5' THEN 'is none of' ELSE 'loaded' END AS state, CASE WHEN source LIKE '%5' THEN 0 ELSE count(*) END AS n FROM documents GROUP BY source")
def udf02(spark: SparkSession, sf: str) -> DataFrame:
    """Each source of the documents is asked for by name; loaders of names that end in 5 aren't registered, and the registry says so."""
    docs = run(spark, sf, "SELECT doc_id, source FROM documents")
    names = [r.source for r in docs.select("source").distinct().collect()]  # the vocabulary of sources
    registry = Registry()
    for name in names:
        if not name.endswith("5"):
            registry.add(name)(lambda rows, name=name: rows.where(F.col("source") == name).groupBy(F.col("source").alias("name")).agg(F.lit("loaded").alias("state"), F.count("*").alias("n")))
    parts = []
    for name in names:
        try:
            parts.append(registry.load(name, docs))
        except KeyError as e:
            parts.append(spark.range(1).select(F.lit(name).alias("name"), F.lit("is none of" if f"{name} is none of" in str(e) else "?").alias("state"), F.lit(0).cast("long").alias("n")))
    return sets.concat_all(*parts)


def _drawn(what: str, n: str) -> str:
    return f"(('0x' || substr(md5(CAST(seed AS VARCHAR) || ':' || CAST(idx AS VARCHAR) || ':' || {what}), 1, 8))::BIGINT % {n})"


_PAWNS = "len(list_filter(range(1, n_{0}), lambda i: " + _drawn("'{0}' || CAST(i AS VARCHAR)", "100") + " < 50))"
_ASKED = "list_concat(['total_white', 'total_black'], " + ", ".join(f"CASE WHEN {_PAWNS.format(s)} > 0 OR {_drawn(f"'ask_{s}'", '2')} = 0 THEN ['pawns_{s}'] ELSE [] END" for s in ("white", "black")) + ")"
_GENERATED = f"""
WITH q AS (SELECT p_partkey AS seed, unnest(range(p_size % 4 + 1)) AS idx, p_size % 5 AS kind FROM part),
facts AS (SELECT *, 3 + {_drawn("'rows'", "8")} AS r, 3 + {_drawn("'cols'", "8")} AS c, ['circle', 'square', 'triangle', 'star', 'diamond'][{_drawn("'shape'", "5")} + 1] AS shape,
  {_drawn("'canton'", "2")} = 0 AS canton, 3 + {_drawn("'stripes'", "11")} AS stripes, 1 + {_drawn("'stars'", "25")} AS stars, 3 + {_drawn("'size'", "10")} AS size,
  2 + {_drawn("'white'", "15")} AS n_white, 2 + {_drawn("'black'", "15")} AS n_black, [4, 2, 6, 8][{_drawn("'kind'", "4")} + 1] AS legs, {_drawn("'legs'", "10")} AS other FROM q),
named AS (SELECT *, CASE kind WHEN 0 THEN ['rows', 'cols', 'total'][{_drawn("'variant'", "3")} + 1] WHEN 1 THEN CASE WHEN canton AND {_drawn("'variant'", "10")} < 6 THEN 'stars' ELSE 'stripes' END
  WHEN 2 THEN ['rows', 'cols', 'dark'][{_drawn("'variant'", "3")} + 1] WHEN 3 THEN {_ASKED}[{_drawn("'variant'", f"len({_ASKED})")} + 1] ELSE 'legs' END AS variant FROM facts)
SELECT seed, idx, ['patterned_grid', 'flag', 'game_board', 'chess_position', 'animal'][kind + 1] AS topic, variant,
  CASE kind WHEN 0 THEN CASE variant WHEN 'rows' THEN 'How many rows are in the grid?' WHEN 'cols' THEN 'How many columns are in the grid?' ELSE 'How many ' || shape || 's are in the grid?' END
    WHEN 1 THEN CASE variant WHEN 'stars' THEN 'How many stars are on the flag?' ELSE 'How many stripes does this flag have?' END
    WHEN 2 THEN CASE variant WHEN 'rows' THEN 'How many rows does this game board have?' WHEN 'cols' THEN 'How many columns does this game board have?' ELSE 'How many dark colored squares are on the board?' END
    WHEN 3 THEN 'How many ' || split_part(variant, '_', 2) || CASE WHEN variant LIKE 'total%' THEN ' pieces' ELSE ' pawns' END || ' are on the board?'
    ELSE 'How many legs does the creature in the image have?' END AS question,
  CAST(CASE kind WHEN 0 THEN CASE variant WHEN 'rows' THEN r WHEN 'cols' THEN c ELSE r * c END WHEN 1 THEN CASE variant WHEN 'stars' THEN stars ELSE stripes END
    WHEN 2 THEN CASE variant WHEN 'dark' THEN size * size // 2 ELSE size END
    WHEN 3 THEN CASE variant WHEN 'total_white' THEN n_white WHEN 'total_black' THEN n_black WHEN 'pawns_white' THEN {_PAWNS.format("white")} ELSE {_PAWNS.format("black")} END
    ELSE CASE WHEN {_drawn("'usual'", "10")} < 3 THEN legs ELSE other + CASE WHEN other >= legs THEN 1 ELSE 0 END END END AS VARCHAR) AS gold FROM named
"""


@query("UDF03", _GENERATED)
def udf03(spark: SparkSession, sf: str) -> DataFrame:
    """Each part asks for one to four questions of one of the five topics."""
    topic = F.element_at(F.array(*[F.lit(t) for t in generators.GENERATORS]), (F.col("p_size") % 5 + 1).cast("int"))
    asking = run(spark, sf, "SELECT p_partkey AS seed, p_size FROM part").select("seed", topic.alias("topic"), (F.col("p_size") % 4 + 1).alias("n"))
    return generators.ask(asking).select("seed", "idx", "topic", F.get_json_object("extras", "$.q_variant").alias("variant"), "question", "gold")


_RECIPE = "round(sum(CASE WHEN NOT mask THEN 0 WHEN {0} AND loss_branch = 'ce' THEN -log_prob * coalesce(beta, 0.1) ELSE raw_kl * {1} END), 4)"


@query("UDF04", "SELECT batch_id, " + ", ".join(f"{_RECIPE.format('true' if sift else 'false', 'delta' if weigh else '1')} AS {name}" for name, (weigh, sift) in T.RECIPES.items()) + " FROM tok GROUP BY batch_id", tok=TOK)
def udf04(spark: SparkSession, sf: str) -> DataFrame:
    out = run(spark, sf, TOK).withColumnRenamed("delta", "weight")
    for name in T.RECIPES:
        out = T.recipe_loss(out, name).withColumnRenamed("loss", name)
    return out.groupBy("batch_id").agg(*[F.round(F.sum(name), 4).alias(name) for name in T.RECIPES])


@query("UDF05", "SELECT doc_id, 0.0 AS reward FROM documents")
def udf05(spark: SparkSession, sf: str) -> DataFrame:
    return T.reward(run(spark, sf, "SELECT doc_id FROM documents"))


_DCT = """
WITH cell AS (SELECT k, r, greatest(least((k + 1) / 4.0E0, r + 1) - greatest(k / 4.0E0, r), 0) * 4 AS w FROM range(32) AS a(k), range(8) AS b(r)),
wave AS (SELECT u, r, sum(cos(pi() * u * (2 * k + 1) / 64.0E0) * w) AS a FROM cell, range(8) AS c(u) GROUP BY u, r),
gray AS (SELECT vec_id, unnest(embedding)::DOUBLE AS g, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id % 10 <> 3),
low AS (SELECT vec_id, y.u * 8 + x.u AS i, sum(y.a * g * x.a) AS f FROM gray JOIN wave y ON y.r = i // 8 JOIN wave x ON x.r = i % 8 GROUP BY ALL),
mid AS (SELECT vec_id, median(f) AS m FROM low GROUP BY vec_id)
SELECT CAST(vec_id AS VARCHAR) AS path, CAST(sum(CASE WHEN f <= m THEN 0 WHEN i = 0 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << CAST(63 - i AS INTEGER) END) AS VARCHAR) AS h, false AS failed FROM low JOIN mid USING (vec_id) GROUP BY vec_id
UNION ALL SELECT CAST(vec_id AS VARCHAR), NULL, true FROM embeddings WHERE vec_id % 10 = 3
"""


def _gray(data: bytes) -> np.ndarray:
    return np.array(json.loads(data), float).reshape(8, -1)


@query("UDF06", _DCT)
def udf06(spark: SparkSession, sf: str) -> DataFrame:
    """Perceptual hashes of embeddings taken as gray images of eight rows; some files are broken, which is told and stops nothing."""
    data = F.when(F.col("vec_id") % 10 == 3, "[1, 2").otherwise(F.to_json(F.col("embedding").cast("array<double>"))).cast("binary")
    files = run(spark, sf, "SELECT vec_id, embedding FROM embeddings").select(F.col("vec_id").cast("string").alias("path"), data.alias("bytes"))
    # as text: a null among whole numbers would make them doubles in pandas
    return pluggable.hash_images(files, pluggable.image_hasher(_gray)).withColumn("h", F.col("h").cast("string"))


@query("UDF07", "SELECT doc_id, [n_chars::DOUBLE, 1.0] AS v FROM documents")
def udf07(spark: SparkSession, sf: str) -> DataFrame:
    return pluggable.embed(run(spark, sf, "SELECT doc_id, n_chars FROM documents"), lambda values: [[float(x), 1.0] for x in values], "doc_id", "n_chars")


@query("UDF08", "SELECT doc_id, CAST(length(source) AS BIGINT) AS n FROM documents")
def udf08(spark: SparkSession, sf: str) -> DataFrame:
    rows = pluggable.tokenize(run(spark, sf, "SELECT doc_id, source FROM documents"), "source", lambda s: [ord(c) for c in s])
    return rows.select("doc_id", F.size("token_ids").cast("bigint").alias("n"))


@query("UDF09", "SELECT n_nationkey AS k, CAST(length(n_name) + 1 AS BIGINT) AS n_bytes FROM nation WHERE n_regionkey = 1")
def udf09(spark: SparkSession, sf: str) -> DataFrame:
    """Files are read lazily: only those that wanted rows name."""
    from siftwell.session import scratch
    from siftwell.sources.records import read_binary

    folder = scratch(spark, "udf09")
    run(spark, sf, "SELECT n_nationkey AS k, n_name AS value FROM nation").write.partitionBy("k").text(folder)
    files = read_binary(spark, f"{folder}/*/part-*").withColumn("path", F.regexp_extract("path", r"k=(\d+)", 1))
    wanted = run(spark, sf, "SELECT n_nationkey AS k, CAST(n_nationkey AS STRING) AS path FROM nation WHERE n_regionkey = 1")
    return J.with_bytes(wanted, files).where("NOT load_error").select("k", F.length("bytes").cast("bigint").alias("n_bytes"))


@query("spike_top1_changes", "SELECT count(*) AS n, count(*) FILTER (list_position(a, list_max(a)) <> list_position(b, list_max(b))) AS n_changed FROM ser", ser=SER)
def spike_top1_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).agg(F.count("*").alias("n"), F.count_if(A.first_argmax(F.col("a")) != A.first_argmax(F.col("b"))).alias("n_changed"))


@query("topic_seed", "SELECT n_nationkey, CAST(('0x' || substr(sha256('42:' || n_name), 1, 8))::BIGINT AS BIGINT) AS seed FROM nation")
def topic_seed(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, "SELECT n_nationkey, n_name FROM nation").select("n_nationkey", pluggable.topic_seed(42, F.col("n_name")).alias("seed"))


@query("step_table", "SELECT step, max(value) FILTER (metric = 'actor/loss') AS \"actor/loss\", max(value) FILTER (metric = 'perf/x') AS \"perf/x\" FROM s WHERE metric IN ('actor/loss', 'perf/x') GROUP BY step", s=_LAST)
def step_table(spark: SparkSession, sf: str) -> DataFrame:
    return pivot_steps(last_by_step(log_series(run(spark, sf, LOG))).where("metric IN ('actor/loss', 'perf/x')"))


@query("stream_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: event-time windows, the same plan as for a stream."""
    return windowed_counts(run(spark, sf, "SELECT ts, event_type, value FROM events")).withColumn("total", F.round("total", 4))


@query("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders")
def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return R.row_index(run(spark, sf, "SELECT o_orderkey FROM orders"), "o_orderkey", name="i").withColumn("i", F.col("i").cast("bigint"))


@query("text_leak", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def text_leak(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an evaluation text: the bounded evaluation set against all documents."""
    docs, items = run(spark, sf, "SELECT doc_id, text FROM documents"), run(spark, sf, "SELECT item_id, text AS item FROM benchmark")
    return J.containing(docs, items, "text", "item").select("doc_id", "item_id")


@query("choice_letters", "SELECT doc_id, doc_id % 2 = 0 AS ok FROM documents")
def choice_letters(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, "( B )").otherwise("(C)")
    return run(spark, sf, "SELECT doc_id FROM documents").select("doc_id", X.verifies(text, F.lit("b")).alias("ok"))
