"""Queries of row-level operators: projections, filters, set operations, text and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import arrays as A
from siftwell.functions import stats as S
from siftwell.functions import text as X
from siftwell.operators import aggregates as G
from siftwell.operators import filters as P
from siftwell.operators import joins as J
from siftwell.operators import projections as R
from siftwell.operators import sets
from siftwell.plans import tokens as T
from siftwell.queries.base import ANN, LOG, REC, SERIES, TOK, query, run
from siftwell.queries.sources import TALLY_SQL, VIRL_SQL, _virl
from siftwell.sources import datasets as D
from siftwell.streaming.logs import log_series

#: Free text with its answer forms; chr(92) is a backslash in both engines.
TXT = """
SELECT doc_id, CAST(doc_id % 30 AS STRING) AS k,
  CASE doc_id % 7 WHEN 0 THEN 'so ' || chr(92) || 'boxed{' || CAST(doc_id % 30 AS STRING) || '} ok'
    WHEN 1 THEN 'I know: yes' WHEN 2 THEN ' Yes, not no ' WHEN 3 THEN 'There are 3 of -' || CAST(doc_id % 30 AS STRING)
    WHEN 4 THEN chr(9) || 'it is {No} here' || chr(10) WHEN 5 THEN chr(92) || 'boxed{}' ELSE ' (B). ' END AS s,
  CASE doc_id % 3 WHEN 0 THEN 'vlmbias_main' WHEN 1 THEN 'pope_adversarial' ELSE 'mathvista_mini' END AS dataset
FROM documents
"""

#: Vectors as arrays of doubles and short series of tokens.
_SER = "doc_id, doc_id % 6 + 2 AS n"


def _rec(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, REC)


def _txt(spark: SparkSession, sf: str, *cols: Column) -> DataFrame:
    return run(spark, sf, TXT).select("doc_id", *cols)


def _series(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n, a array of n doubles, b array of (doc_id % 4 + 1) doubles)."""
    base = run(spark, sf, f"SELECT {_SER} FROM documents")
    d = F.col("doc_id")
    a = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (d * i % 23) / F.lit(23.0))
    b = F.transform(F.sequence(F.lit(1), d % 4 + 1), lambda i: (d * i % 7) / F.lit(7.0))
    return base.select("doc_id", "n", a.alias("a"), b.alias("b"))


SER = """
SELECT doc_id, doc_id % 6 + 2 AS n, list_transform(range(1, doc_id % 6 + 3), lambda i: (doc_id * i % 23) / 23.0) AS a,
  list_transform(range(1, doc_id % 4 + 2), lambda i: (doc_id * i % 7) / 7.0) AS b FROM documents
"""

# --- projections


@query("PRJ01", "SELECT sample_id, topic || '?' AS question, gold FROM rec", rec=REC)
def prj01(spark: SparkSession, sf: str) -> DataFrame:
    return R.to_sample(_rec(spark, sf), sample_id=F.col("sample_id"), question=F.concat("topic", F.lit("?")), gold=F.col("gold"))


@query("PRJ02", "SELECT sample_id, topic AS bucket, 'q' AS question, gold, sample_id || '.jpg' AS image_path FROM rec", rec=REC)
def prj02(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf).select("sample_id", F.lit("q").alias("question"), "gold", "topic", F.array(F.concat("sample_id", F.lit(".jpg"))).alias("image_paths"))
    return R.to_manifest(rows, F.col("topic"))


_TRAIN = "SELECT 'e1_' || topic AS data_source, '<image>' || chr(10) || topic AS content, gold AS gold_text, 'Final answer: \\boxed{' || gold || '}.' AS gold_response_text, coalesce(CASE WHEN doc_id % 4 > 0 THEN correct END, correct_i) AS trajectory_pass, sample_id FROM rec"


@query("PRJ03", _TRAIN, rec=REC)
def prj03(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf).select(
        F.col("topic").alias("bucket"), "sample_id", F.col("topic").alias("question"), "gold", F.col("gold").cast("binary").alias("image"), F.col("topic").alias("category"), "source",
        F.when(F.col("doc_id") % 4 > 0, F.col("correct")).alias("trajectory_pass"), F.col("correct_i").alias("correct_I"),
    )
    return R.train_rows(rows).select("data_source", F.col("prompt")[0]["content"].alias("content"), "gold_text", "gold_response_text", "trajectory_pass", "sample_id")


@query("PRJ04", "SELECT sample_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN topic END, 'other') AS bucket FROM rec", rec=REC)
def prj04(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).select("sample_id", R.bucket_of(F.when(F.col("doc_id") % 3 == 0, F.col("topic")), "other").alias("bucket"))


@query("PRJ05", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM rec WHERE error IS NULL", rec=REC)
def prj05(spark: SparkSession, sf: str) -> DataFrame:
    return R.row_index(_rec(spark, sf).where("error IS NULL").select("doc_id"), "doc_id").withColumn("index", F.col("index").cast("bigint"))


@query("PRJ06", "SELECT topic, count(*) AS \"acc.n\", count(*) FILTER (correct_i) AS \"acc.k\" FROM rec GROUP BY topic", rec=REC)
def prj06(spark: SparkSession, sf: str) -> DataFrame:
    return R.flatten(_rec(spark, sf).groupBy("topic").agg(F.struct(F.count("*").alias("n"), F.count_if("correct_i").alias("k")).alias("acc")))


@query("PRJ07", "SELECT sample_id, CASE dataset WHEN 'pope_adversarial' THEN 'no,yes' WHEN 'vlmbias_main' THEN 'expected_bias,ground_truth' ELSE '' END AS options FROM rec", rec=REC)
def prj07(spark: SparkSession, sf: str) -> DataFrame:
    options = R.options_for(F.col("dataset"), F.col("gold"), F.col("prior"))
    return _rec(spark, sf).select("sample_id", F.array_join(F.sort_array(F.map_keys(options)), ",").alias("options"))


@query("PRJ08", "SELECT sample_id, 'e1_' || topic AS data_source, '<image>' || chr(10) || source AS prompt FROM rec", rec=REC)
def prj08(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).select("sample_id", X.templated("e1_%s", F.col("topic")).alias("data_source"), X.templated("<image>\n%s", F.col("source")).alias("prompt"))


@query("PRJ09", "SELECT doc_id, list_transform(range(1, 6), lambda i: coalesce(a[i], 0.0)) AS a FROM ser", ser=SER)
def prj09(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).select("doc_id", A.pad(F.col("a"), 5).alias("a"))


@query("PRJ10", "SELECT doc_id, a[doc_id % 2 + 1 : doc_id % 2 + 2] AS a FROM ser", ser=SER)
def prj10(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).select("doc_id", A.response_slice(F.col("a"), (F.col("doc_id") % 2 + 1).cast("int"), F.lit(2)).alias("a"))


@query("PRJ11", "SELECT doc_id, a[1 : least(len(a), len(b))] AS a FROM ser", ser=SER)
def prj11(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).select("doc_id", A.trim_to(F.col("a"), F.col("b")).alias("a"))


# --- filters


def _ids(df: DataFrame) -> DataFrame:
    return df.select("doc_id")


@query("FLT01", "SELECT doc_id FROM rec WHERE mean_delta >= 0.3 AND mean_delta <= 0.9", rec=REC)
def flt01(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(_rec(spark, sf).where(P.in_range(F.col("mean_delta"), 0.3, 0.9)))


@query("FLT02", "SELECT qid FROM v WHERE n_images = 1", v=VIRL_SQL)
def flt02(spark: SparkSession, sf: str) -> DataFrame:
    return _virl(spark, sf).where(P.single(F.col("image"))).select("qid")


@query("FLT03", "SELECT doc_id FROM t WHERE doc_id % 7 IN (0, 5)", t=TXT)
def flt03(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(run(spark, sf, TXT).where(X.has_boxed(F.col("s"))))


@query("FLT04", "SELECT image_id FROM t WHERE NOT coalesce(issimple, false)", t=TALLY_SQL)
def flt04(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, TALLY_SQL).where(P.not_simple(F.col("issimple"))).select("image_id")


@query("FLT05", "SELECT image_id FROM t WHERE image <> ''", t=TALLY_SQL)
def flt05(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, TALLY_SQL).where(P.non_empty(F.col("image"))).select("image_id")


@query("FLT06", "SELECT image_id FROM t WHERE lower(data_source) = 'coco2014'", t=TALLY_SQL)
def flt06(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, TALLY_SQL).where(P.source_in(F.col("data_source"), D.COCO_SOURCES)).select("image_id")


@query("FLT07", "SELECT image_id FROM t WHERE TRY_CAST(answer AS BIGINT) BETWEEN 0 AND 15", t=TALLY_SQL)
def flt07(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, TALLY_SQL).where(P.integer_in(F.col("answer"), 0, 15)).select("image_id")


@query("FLT08", "SELECT CASE WHEN coalesce(issimple, false) THEN 'simple' WHEN image = '' THEN 'no_image' WHEN data_source = 'COCO2014' AND image_id % 5 = 0 THEN 'leaked' WHEN coalesce(TRY_CAST(answer AS BIGINT) NOT BETWEEN 0 AND 15, true) THEN 'answer' ELSE 'kept' END AS reason, count(*) AS n FROM t GROUP BY 1", t=TALLY_SQL)
def flt08(spark: SparkSession, sf: str) -> DataFrame:
    seen = run(spark, sf, "SELECT doc_id AS image_id FROM documents WHERE doc_id % 5 = 0")
    return P.reject_counts(D.mark_leaked(run(spark, sf, TALLY_SQL), seen), D.tally_checks(seen))


@query("FLT09", "SELECT doc_id FROM rec WHERE dataset LIKE 'vlmbias%'", rec=REC)
def flt09(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(_rec(spark, sf).where(F.col("dataset").startswith("vlmbias")))


@query("FLT10", "SELECT doc_id FROM rec WHERE topic IN ('en', 'de')", rec=REC)
def flt10(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(_rec(spark, sf).where(F.col("topic").isin("en", "de")))


@query("FLT11", "SELECT image_id, count(*) AS n FROM ann GROUP BY image_id HAVING count(*) >= 3 AND image_id % 7 <> 0", ann=ANN)
def flt11(spark: SparkSession, sf: str) -> DataFrame:
    seen = run(spark, sf, "SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey % 7 = 0")
    return D.eligible_images(run(spark, sf, ANN), seen).select("image_id", F.size("cats").cast("bigint").alias("n"))


@query("FLT12", "SELECT doc_id FROM rec WHERE topic IN ('en', 'fr', 'es')", rec=REC)
def flt12(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(P.with_reject_reason(_rec(spark, sf), [("bucket", F.col("topic").isin("en", "fr", "es"))]).where("reject_reason IS NULL"))


@query("FLT13", "SELECT metric, count(*) AS n FROM s GROUP BY metric", s=SERIES)
def flt13(spark: SparkSession, sf: str) -> DataFrame:
    rows = log_series(run(spark, sf, LOG)).where(P.finite_values(F.col("value")))
    return rows.groupBy("metric").agg(F.count("*").alias("n"))


@query("FLT14", "SELECT line_no FROM s WHERE metric = 'actor/grad_norm'", s=SERIES)
def flt14(spark: SparkSession, sf: str) -> DataFrame:
    return log_series(run(spark, sf, LOG)).where((F.col("metric") == "actor/grad_norm") & P.finite_values(F.col("value"))).select("line_no")


@query("FLT15", "SELECT doc_id FROM t WHERE doc_id % 7 = 2", t=TXT)
def flt15(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(run(spark, sf, TXT).where(X.says_yes(F.col("s"))))


@query("FLT16", "SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def flt16(spark: SparkSession, sf: str) -> DataFrame:
    gold = F.when(F.col("doc_id") % 4 == 0, " \t\n").when(F.col("doc_id") % 4 == 1, " x ").when(F.col("doc_id") % 4 == 2, "")
    return _ids(run(spark, sf, "SELECT doc_id FROM documents").where(P.non_blank(gold)))


# --- set operations


@query("SET01", "SELECT source, count(*) AS n, count(topic) AS n_topic FROM (SELECT source, topic FROM rec WHERE doc_id % 2 = 0 UNION ALL SELECT source, NULL FROM rec WHERE doc_id % 2 = 1) GROUP BY source", rec=REC)
def set01(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rec(spark, sf)
    both = sets.concat_all(rows.where("doc_id % 2 = 0").select("source", "topic"), rows.where("doc_id % 2 = 1").select("source"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("topic").alias("n_topic"))


def _ab(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tuple(run(spark, sf, f"SELECT doc_id FROM documents WHERE doc_id % {k} = 0") for k in (3, 5))


@query("SET02", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def set02(spark: SparkSession, sf: str) -> DataFrame:
    return sets.id_union(*_ab(spark, sf))


@query("SET03", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def set03(spark: SparkSession, sf: str) -> DataFrame:
    return sets.id_intersection(*_ab(spark, sf))


@query("SET04", "SELECT doc_id, list_filter(a, lambda x: NOT list_contains(b, x)) AS d FROM ser", ser=SER)
def set04(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).select("doc_id", sets.difference(F.col("a"), F.col("b")).alias("d"))


@query("SET05", "SELECT doc_id, list_sort(list_distinct([doc_id % 3, doc_id % 5 + 1, doc_id % 4, doc_id % 7 + 1])) AS keys FROM documents")
def set05(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    d = F.col("doc_id")
    p, q = F.create_map(d % 3, F.lit(1), d % 5 + 1, F.lit(2)), F.create_map(d % 4, F.lit(1), d % 7 + 1, F.lit(2))
    return run(spark, sf, "SELECT doc_id FROM documents").select("doc_id", F.sort_array(sets.key_union(p, q)).alias("keys"))


@query("SET06", "SELECT topic, count(*) AS n FROM rec GROUP BY topic", rec=REC)
def set06(spark: SparkSession, sf: str) -> DataFrame:
    from siftwell.queries.sources import _jsonl

    rows = _rec(spark, sf).select("doc_id", "topic")
    paths = [_jsonl(rows.where(F.col("doc_id") % 3 == k), "set06") for k in range(3)]
    return spark.read.schema("topic string").json(paths).groupBy("topic").agg(F.count("*").alias("n"))


# --- text


@query("STR01", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN k WHEN 5 THEN '' END AS a FROM t", t=TXT)
def str01(spark: SparkSession, sf: str) -> DataFrame:
    return _txt(spark, sf, X.boxed(F.col("s")).alias("a"))


@query("STR02", "SELECT qid, 'what is ' || qid AS a FROM v", v=VIRL_SQL)
def str02(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, VIRL_SQL).select("qid", X.strip_placeholders(F.col("question")).alias("a"))


_YESNO = "CASE WHEN instr(lower(s), 'yes') = 0 AND instr(lower(s), 'no') = 0 THEN lower(s) WHEN instr(lower(s), 'yes') > 0 AND (instr(lower(s), 'no') = 0 OR instr(lower(s), 'yes') < instr(lower(s), 'no')) THEN 'yes' ELSE 'no' END"


@query("STR03", f"SELECT doc_id, {_YESNO} AS a FROM t", t=TXT)
def str03(spark: SparkSession, sf: str) -> DataFrame:
    return _txt(spark, sf, X.yes_no(F.col("s")).alias("a"))


@query("STR04", f"SELECT doc_id, CASE dataset WHEN 'pope_adversarial' THEN {_YESNO} WHEN 'mathvista_mini' THEN lower(s) ELSE CASE WHEN regexp_matches(s, '\\{{[^}}]+\\}}') THEN lower(trim(regexp_extract(s, '\\{{([^}}]+)\\}}', 1))) ELSE coalesce(lower(regexp_extract_all(s, '[\\w\\-]+')[-1]), s) END END AS a FROM (SELECT doc_id, dataset, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM t)", t=TXT)
def str04(spark: SparkSession, sf: str) -> DataFrame:
    return _txt(spark, sf, X.answer(F.col("dataset"), F.col("s")).alias("a"))


@query("STR05", "SELECT doc_id, contains(s, k) AS ok FROM (SELECT doc_id, lower(s) AS s, k FROM t WHERE dataset = 'mathvista_mini')", t=TXT)
def str05(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, TXT).where("dataset = 'mathvista_mini'").select("doc_id", X.is_correct(F.col("dataset"), F.col("s"), F.col("k")).alias("ok"))


@query("STR06", "SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(s, '^\\s+|\\s+$', '', 'g')), '[.!?,;:]+$', ''), '\\s+', ' ', 'g') AS a FROM t", t=TXT)
def str06(spark: SparkSession, sf: str) -> DataFrame:
    return _txt(spark, sf, X.loose(F.col("s")).alias("a"))


@query("STR07", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN true WHEN 3 THEN doc_id % 30 = 0 ELSE false END AS ok FROM t", t=TXT)
def str07(spark: SparkSession, sf: str) -> DataFrame:
    return _txt(spark, sf, X.verifies(F.col("s"), F.col("k")).alias("ok"))


@query("STR08", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN doc_id % 30 WHEN 3 THEN -(doc_id % 30) END AS a FROM t WHERE doc_id % 7 IN (0, 3)", t=TXT)
def str08(spark: SparkSession, sf: str) -> DataFrame:
    return _txt(spark, sf, X.last_integer(F.col("s")).alias("a")).where("a IS NOT NULL")


@query("STR09", "SELECT doc_id, doc_id AS a FROM documents WHERE doc_id % 3 <> 2")
def str09(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.when(d % 3 == 0, F.concat(F.lit("COCO_val_000"), d.cast("string"), F.lit(".JPEG"))).when(d % 3 == 1, d.cast("string")).otherwise("none.txt")
    return run(spark, sf, "SELECT doc_id FROM documents").select("doc_id", X.image_id(name).alias("a")).where("a IS NOT NULL")


@query("STR10", "SELECT doc_id, 'Final answer: ' || chr(92) || 'boxed{' || gold || '}.' AS a FROM rec", rec=REC)
def str10(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).select("doc_id", X.gold_response(F.col("gold")).alias("a"))


@query("STR11", "SELECT step, metric, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY ALL", s=SERIES)
def str11(spark: SparkSession, sf: str) -> DataFrame:
    rows = log_series(run(spark, sf, LOG)).where(S.finite(F.col("value")))
    return rows.groupBy("step", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("STR12", "SELECT doc_id, doc_id % 7 IN (1, 6) OR contains(lower(s), k || '}') AS ok FROM t", t=TXT)
def str12(spark: SparkSession, sf: str) -> DataFrame:
    return _txt(spark, sf, X.choice_parsed(F.col("s"), F.array(F.concat("k", F.lit("}")), F.lit("Know"))).alias("ok"))


@query("STR13", "SELECT doc_id, lower(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS a FROM t", t=TXT)
def str13(spark: SparkSession, sf: str) -> DataFrame:
    return _txt(spark, sf, X.canonical(F.col("s")).alias("a"))


@query("STR14", "SELECT doc_id, 'Is there a ' || topic || ' in the image?' AS a FROM rec", rec=REC)
def str14(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).select("doc_id", X.templated("Is there a %s in the image?", F.col("topic")).alias("a"))


@query("STR15", "SELECT image_id, CASE WHEN question_id IS NOT NULL THEN 'tally_' || image_id || '_' || question_id ELSE md5('tally|' || image_id || '|') END AS a FROM t", t=TALLY_SQL)
def str15(spark: SparkSession, sf: str) -> DataFrame:
    rows = run(spark, sf, TALLY_SQL)
    return rows.select("image_id", X.joined_id(F.lit("tally"), F.col("image_id").cast("string"), F.col("question_id").cast("string")).alias("a"))


@query("STR16", "SELECT doc_id, CASE WHEN bias_i IS NULL THEN '-' ELSE format('{:.3f}', bias_i) END AS a FROM rec", rec=REC)
def str16(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).select("doc_id", X.fixed(F.col("bias_i")).alias("a"))


# --- arithmetic

_P = {1: "-0.1 - doc_id % 5", 2: "-2.4 - doc_id % 3"}
KL = """
SELECT doc_id, ep1 / (ep1 + ep2 + ep3) AS p1, ep2 / (ep1 + ep2 + ep3) AS p2, ep3 / (ep1 + ep2 + ep3) AS p3,
  eq1 / (eq1 + eq2 + eq3) AS q1, eq2 / (eq1 + eq2 + eq3) AS q2, eq3 / (eq1 + eq2 + eq3) AS q3
FROM (SELECT doc_id, exp(-0.1 - doc_id % 5) AS ep1, exp(-2.4 - doc_id % 3) AS ep2, least(exp(-0.1 - doc_id % 5), exp(-2.4 - doc_id % 3)) AS ep3,
  exp(-0.5 - doc_id % 2) AS eq1, least(exp(-0.5 - doc_id % 2), exp(-1.2 - doc_id % 7)) AS eq2, exp(-1.2 - doc_id % 7) AS eq3 FROM documents)
"""


def _maps(spark: SparkSession, sf: str) -> tuple[DataFrame, Column, Column]:
    d = F.col("doc_id")
    p = F.create_map(F.lit(1), F.lit(-0.1) - d % 5, F.lit(2), F.lit(-2.4) - d % 3)
    q = F.create_map(F.lit(1), F.lit(-0.5) - d % 2, F.lit(3), F.lit(-1.2) - d % 7)
    return run(spark, sf, "SELECT doc_id FROM documents").select("doc_id", p.alias("p"), q.alias("q")), F.col("p"), F.col("q")


@query("MTH01", "SELECT doc_id, round(p1 * ln(p1 / q1) + p2 * ln(p2 / q2) + p3 * ln(p3 / q3), 8) AS kl FROM kl", kl=KL)
def mth01(spark: SparkSession, sf: str) -> DataFrame:
    df, p, q = _maps(spark, sf)
    return df.select("doc_id", F.round(A.kl_union(p, q), 8).alias("kl"))


_W = "SELECT w.*, round(CASE WHEN mean IS NULL THEN 1.0 ELSE c / greatest(mean, 1e-6) END, 6) AS weight FROM (SELECT *, avg(CASE WHEN mask THEN c END) OVER (PARTITION BY batch_id) AS mean FROM (SELECT *, least(delta, quantile_cont(CASE WHEN mask THEN delta END, 0.95) OVER (PARTITION BY batch_id)) AS c FROM tok)) w"


@query("MTH02", f"SELECT sample_id, t, weight FROM ({_W})", tok=TOK)
def mth02(spark: SparkSession, sf: str) -> DataFrame:
    return T.delta_weights(run(spark, sf, TOK), "batch_id").select("sample_id", "t", F.round("weight", 6).alias("weight"))


@query("MTH03", "SELECT doc_id, list_transform(a, lambda x: CASE WHEN doc_id % 2 = 0 THEN round(-x * x, 9) + 0.0 ELSE 0.0 END) AS w FROM ser", ser=SER)
def mth03(spark: SparkSession, sf: str) -> DataFrame:
    terms = T.weighted_nll(F.col("a"), F.col("a"), F.col("doc_id") % 2 == 0)
    return _series(spark, sf).select("doc_id", F.transform(terms, lambda x: F.round(x, 9) + 0.0).alias("w"))  # + 0.0: no negative zero


@query("MTH04", "SELECT sample_id, t, round(CASE WHEN loss_branch = 'ce' THEN -log_prob * coalesce(beta, 0.1) ELSE raw_kl END, 6) AS loss FROM tok", tok=TOK)
def mth04(spark: SparkSession, sf: str) -> DataFrame:
    loss = T.branch_loss(F.col("raw_kl"), F.col("log_prob"), F.coalesce("loss_branch", F.lit("kl")) == "ce", F.coalesce("beta", F.lit(0.1)))
    return run(spark, sf, TOK).select("sample_id", "t", F.round(loss, 6).alias("loss"))


@query("MTH05", "SELECT doc_id, greatest(gt_i - gt_null, 0) AS x FROM rec", rec=REC)
def mth05(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).select("doc_id", S.clamp0(F.col("gt_i") - F.col("gt_null")).alias("x"))


@query("MTH06", "SELECT doc_id, CAST(bit_count(xor(doc_id, n_chars)) AS BIGINT) AS x FROM documents")
def mth06(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, "SELECT doc_id, n_chars FROM documents").select("doc_id", A.hamming(F.col("doc_id"), F.col("n_chars")).cast("bigint").alias("x"))


@query("MTH07", "SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)), 4) AS norm2, 1.0 AS unit FROM embeddings")
def mth07(spark: SparkSession, sf: str) -> DataFrame:
    rows = run(spark, sf, "SELECT vec_id, embedding FROM embeddings").withColumn("u", A.normalized(F.col("embedding")))
    return rows.select("vec_id", F.round(A.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2"), F.round(A.dot(F.col("u"), F.col("u")), 6).alias("unit"))


KL_T = "SELECT doc_id, ep1 / (ep1 + ep2) AS p1, ep2 / (ep1 + ep2) AS p2, eq1 / (eq1 + eq2) AS q1, eq2 / (eq1 + eq2) AS q2 FROM (SELECT doc_id, exp(-0.1 - doc_id % 5) AS ep1, exp(-2.4 - doc_id % 3) AS ep2, exp(-0.5 - doc_id % 2) AS eq1, least(exp(-0.5 - doc_id % 2), exp(-1.2 - doc_id % 7)) AS eq2 FROM documents)"


@query("MTH08", "SELECT doc_id, round(p1 * ln(p1 / q1) + p2 * ln(p2 / q2), 8) AS kl FROM kl", kl=KL_T)
def mth08(spark: SparkSession, sf: str) -> DataFrame:
    df, p, q = _maps(spark, sf)
    return df.select("doc_id", F.round(A.kl_teacher_support(p, q), 8).alias("kl"))


@query("MTH09", "SELECT source, k, CASE WHEN k >= 2 THEN 1.0 / (k - 1) ELSE -1.0 END AS chance FROM (SELECT source, count(DISTINCT gold) AS k FROM rec GROUP BY source)", rec=REC)
def mth09(spark: SparkSession, sf: str) -> DataFrame:
    return _rec(spark, sf).groupBy("source").agg(F.countDistinct("gold").alias("k")).withColumn("chance", F.coalesce(S.chance(F.col("k")), F.lit(-1.0)))


@query("MTH10", "SELECT doc_id, CAST(round_even(doc_id / 2, 0) AS BIGINT) AS x FROM documents")
def mth10(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, "SELECT doc_id FROM documents").select("doc_id", S.half_even(F.col("doc_id") / 2).cast("bigint").alias("x"))


@query("MTH11", "SELECT doc_id, round(a[1] - ln(list_sum(list_transform(a, lambda x: exp(x)))), 8) AS x FROM ser", ser=SER)
def mth11(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf).select("doc_id", F.round(A.log_softmax_at(F.col("a"), F.lit(0)), 8).alias("x"))


@query("json_topic", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_topic(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, "SELECT event_id, props FROM events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("map_default", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE -9.0 END AS x FROM documents")
def map_default(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"), F.lit(1.0))
    return run(spark, sf, "SELECT doc_id FROM documents").select("doc_id", A.get_or(m, "a", F.lit(-9.0)).alias("x"))


@query("JON11", "SELECT doc_id, doc_id % 4 = 0 AS load_error FROM documents")
def jon11(spark: SparkSession, sf: str) -> DataFrame:
    docs = run(spark, sf, "SELECT doc_id, CAST(doc_id AS STRING) AS path FROM documents")
    files = docs.where("doc_id % 4 <> 0").select("path", F.col("path").cast("binary").alias("bytes"))
    return J.with_bytes(docs, files).select("doc_id", "load_error")


@query("AGG04", "SELECT doc_id, round(list_sum(a) / len(a), 9) AS m FROM ser", ser=SER)
def agg04(spark: SparkSession, sf: str) -> DataFrame:
    return G.mean_delta(_series(spark, sf), "a", "m").select("doc_id", F.round("m", 9).alias("m"))
