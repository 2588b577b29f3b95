"""Literal fixtures of the text and array functions, and the hazards: Unicode classes, strip, empty against null, ANSI errors."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions import arrays as A
from siftwell.functions import stats as S
from siftwell.functions import text as X


def one(spark, expr, **values):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return df.select(expr.alias("r")).first().r


T, G = F.col("t"), F.col("g")


@pytest.mark.parametrize(
    ("text", "want"),
    [("so \\boxed{\\frac{1}{2}} ok", "\\frac{1}{2}"), ("abc", None), ("\\boxed{}", ""), ("\\boxed{ x\t}", "x"), (None, None)],
)
def test_boxed(spark, text, want):
    assert one(spark, X.boxed(T), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("I know: yes", "no"), ("Yes, no", "yes"), ("maybe", "maybe"), ("NO", "no")])
def test_yes_no(spark, text, want):
    assert one(spark, X.yes_no(T), t=text) == want


@pytest.mark.parametrize(
    ("dataset", "text", "want"),
    [("vlmbias_main", "答案 几何-x", "几何-x"), ("vlmbias_main", "it is { No }", "no"), ("vlmbias_main", "???", "???"), ("pope_adversarial", "Yes", "yes"), ("other", " A b\n", "a b"), ("vlmbias_main", None, "")],
)
def test_answer(spark, dataset, text, want):
    assert one(spark, X.answer(F.col("d"), T), d=dataset, t=text) == want


def test_loose_keeps_the_blank_before_a_stop(spark):
    assert one(spark, X.loose(T), t=" 5 .") == "5 "
    assert one(spark, X.loose(T), t="A　 b!?") == "a b"


@pytest.mark.parametrize(
    ("text", "gold", "want"),
    [("1", "4 - 3 = 1", True), ("(B)", "b", True), ("( B )", "b", True), ("(C)", "b", False), ("", "b", False), ("x", "", False), ("it is 3", "4", False), ("a red car", "red", True), ("\\boxed{7}", "7.0", True)],
)
def test_verifies(spark, text, gold, want):
    assert one(spark, X.verifies(T, G), t=text, g=gold) is want


@pytest.mark.parametrize(("text", "want"), [("There are 3 of -7", -7), ("none", None), ("\\boxed{5 or 6}", 6), ("\\boxed{x} 9", 9), ("", None)])
def test_last_integer(spark, text, want):
    assert one(spark, X.last_integer(T), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("COCO_val2014_000000005802.jpg", 5802), ("12", 12), ("x.gif", None), ("7.PNG", 7)])
def test_image_id(spark, text, want):
    assert one(spark, X.image_id(T), t=text) == want


def test_log_line(spark):
    line = "... training/global_step: 5 actor/loss=0.23 perf/x=1e-3 foo=True a=nan b=-inf"
    got = {r.metric: r.value for r in one(spark, X.log_entries(T), t=line)}
    assert one(spark, X.log_step(T), t=line) == 5
    assert (got["actor/loss"], got["perf/x"], got["b"]) == (0.23, 1e-3, -math.inf)
    assert math.isnan(got["a"]) and "foo" not in got


def test_correctness_by_dataset(spark):
    ask = lambda d, t, g: one(spark, X.is_correct(F.col("d"), T, G), d=d, t=t, g=g)
    assert ask("vlmbias_main", "so {5}", "5") and not ask("vlmbias_main", "so {5}", "6")
    assert ask("pope_adversarial", "No, none", "no") and not ask("pope_adversarial", "perhaps", "perhaps")
    assert ask("mathvista_mini", "It is 42.", "42") and ask("mathvista_mini", "x", "")
    assert not ask("else", "It is 42.", "42")


def _map(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def test_kl(spark):
    assert one(spark, A.kl_union(_map({1: -0.1, 2: -2.4}), _map({1: -0.5, 3: -1.2})), t=1) == pytest.approx(0.239732144102338, abs=1e-12)
    assert one(spark, A.kl_union(_map({1: -0.1}), _map({1: -0.1})), t=1) == 0


def test_arrays(spark):
    a = F.array(*[F.lit(float(x)) for x in (3, 7, 7, 1)])
    assert one(spark, A.first_argmax(a), t=1) == 1
    assert one(spark, A.pad(a, 6), t=1) == [3, 7, 7, 1, 0, 0]
    assert one(spark, A.pad(a, 2), t=1) == [3, 7]
    assert one(spark, A.mean(F.array().cast("array<double>")), t=1) is None
    assert one(spark, A.get_or(_map({"a": 1.0}), "b", F.lit(2.0)), t=1) == 2.0
    assert one(spark, A.hamming(F.lit(0), F.lit(-1).cast("long")), t=1) == 64


def test_percentile_rounding_and_chance(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert df.agg(S.percentile(F.col("x"), 95).alias("p")).first().p == pytest.approx(8.95)
    assert one(spark, S.half_even(F.lit(2.5)), t=1) == 2
    assert one(spark, S.chance(F.lit(2)), t=1) == 1.0 and one(spark, S.chance(F.lit(1)), t=1) is None


def test_spearman_null_cases(spark):
    rows = [("const", 1.0, 5.0), ("const", 2.0, 5.0), ("const", 3.0, 5.0), ("two", 1.0, 1.0), ("two", 2.0, 2.0), ("up", 1.0, 1.0), ("up", 2.0, 4.0), ("up", 9.0, 8.0), ("up", None, 1.0)]
    got = {r.k: r.rho for r in S.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    assert got == {"const": None, "two": None, "up": 1.0}


def test_finite_mean_drops_nan_and_inf(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,)], "x double")
    assert df.agg(S.finite_mean(F.col("x")).alias("m")).first().m == 2.0


def test_confusion_null_on_zero_denominators(spark):
    df = spark.createDataFrame([(False, True), (False, False)], "p boolean, g boolean")
    r = df.agg(*[c.alias(k) for k, c in S.confusion(F.col("p"), F.col("g")).items()]).first()
    assert (r.precision, r.f1, r.recall) == (None, None, 0.0)


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,)], "x double")
    assert {r.bin: r.n for r in S.histogram(df, "x", 0.0, 1.0, 2).collect()} == {1: 1, 2: 2}


def test_average_ranks_equal_windows(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", None if i % 11 == 0 else float(i * 37 % 29)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    ties = F.count("*").over(Window.partitionBy("g", "v")) - 1
    want = df.where("v IS NOT NULL").select("g", "v", (F.rank().over(Window.partitionBy("g").orderBy("v")) + ties / 2).alias("rank"))
    assert sorted(map(repr, S.average_ranks(df, "v", ["g"]).collect())) == sorted(map(repr, want.distinct().collect()))
    assert sorted(map(repr, S.with_ranks(df, "v", ["g"]).collect())) == sorted(map(repr, want.collect()))
    assert S.average_ranks(df.limit(0), "v", ["g"]).count() == 0
    assert [r["rank"] for r in S.average_ranks(spark.createDataFrame([(2.0,), (2.0,), (1.0,)], "v double"), "v", []).orderBy("v").collect()] == [1.0, 2.5]
