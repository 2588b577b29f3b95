"""Operators on small literal tables: joins against brute force, sampling invariants, gates, token sums, scans and sinks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import aggregates as G
from siftwell.operators import filters as P
from siftwell.operators import joins as J
from siftwell.operators import nearest as N
from siftwell.operators.hamming import hamming_pairs, plan_parts
from siftwell.operators import sampling as M
from siftwell.operators import windows as W
from siftwell.plans import config, gates, pluggable
from siftwell.plans import tokens as T
from siftwell.session import scratch
from siftwell.sources import records as R
from siftwell.sources import sinks as K
from siftwell.streaming import logs


def test_hamming_equals_brute_force(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(40)]
    flip = lambda h: h ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 6)))
    left, right = [(i, flip(rnd.choice(base))) for i in range(150)], [(i, flip(rnd.choice(base))) for i in range(120)]
    got = {(r.lid, r.rid, r.distance) for r in hamming_pairs(spark.createDataFrame(left, "lid long, h long"), spark.createDataFrame(right, "rid long, h long")).collect()}
    want = {(i, j, (a ^ b).bit_count()) for i, a in left for j, b in right if (a ^ b).bit_count() < 5}
    assert got == want and want


def test_hamming_bound_is_strict(spark):
    pair = lambda d: hamming_pairs(spark.createDataFrame([(1, 0)], "lid long, h long"), spark.createDataFrame([(2, (1 << d) - 1)], "rid long, h long")).count()
    assert (pair(4), pair(5)) == (1, 0)


def _clustered(seed, n, width=16, clusters=12, spread=0.1):
    rnd = np.random.default_rng(seed)
    middles = np.random.default_rng(99).normal(size=(clusters, width))
    return middles[rnd.integers(0, clusters, n)] + spread * rnd.normal(size=(n, width))


@pytest.mark.parametrize("threshold", [0.3, 0.95, 0.999])
@pytest.mark.parametrize("cell", [10_000, 40, 3])
def test_nearest_equals_all_pairs(spark, threshold, cell):
    """Clusters, vectors without any, copies that tie, one vector that makes up a third of all, zeros and nulls."""
    rnd = np.random.default_rng(1)
    train = np.vstack([_clustered(1, 150), rnd.normal(size=(50, 16)), np.zeros((1, 16))])
    evals = np.vstack([_clustered(2, 150), rnd.normal(size=(50, 16)), train[:5], train[:5] * 3, np.repeat(train[7:8], 100, 0), np.zeros((1, 16))])
    order = rnd.permutation(len(evals))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(train)] + [(500, None), (None, [1.0] * 16)], "tid long, v array<double>")
    e = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(order, evals)] + [(900, None), (None, train[0].tolist())], "eid long, v array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = unit(train) @ unit(evals).T
    want = []
    for i, row in enumerate(s):
        if row.max() > threshold:
            want.append((i, int(min(order[row >= row.max() - 1e-12])), round(float(row.max()), 9)))
    got = sorted((r.tid, r.eid, round(r.similarity, 9)) for r in N.cosine_top1(t, e, threshold, cell).collect())
    assert got == want and (got or threshold > 0.99)


def test_nearest_compares_few_pairs_of_clusters(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    train, evals = unit(_clustered(3, 2000)), unit(_clustered(4, 2000))
    pivots = evals[:40]
    own = N._angles(evals, pivots)
    cell = own.argmin(1)
    files, ranges = {}, np.full((40, 2), [np.inf, -np.inf])
    for c in range(40):
        rows = np.flatnonzero(cell == c)
        pq.write_table(pa.table({"eid": rows, "v": [evals[r].tolist() for r in rows]}), tmp_path / f"{c}.parquet")
        files[c], ranges[c] = [str(tmp_path / f"{c}.parquet")], (own[rows, c].min(), own[rows, c].max())
    best, at, pairs = N.best_of(train, pivots, ranges, N._Cells(files), 0.95)
    assert np.allclose(best, np.maximum((train @ evals.T).max(1), 0.95)) and (at >= 0).all()
    assert pairs < 0.25 * 2000 * 2000


def test_nearest_without_vectors(spark):
    t, e = spark.createDataFrame([(1, [1.0, 0.0])], "tid long, v array<float>"), spark.createDataFrame([(2, [1.0, 0.0])], "eid long, v array<float>")
    assert [tuple(r) for r in N.cosine_top1(t, e).collect()] == [(1, 2, 1.0)]
    assert N.cosine_top1(t.limit(0), e).count() == 0 and N.cosine_top1(t, e.limit(0)).count() == 0


def test_quota_plan():
    assert M.plan_quotas([("a", 10), ("b", 10), ("c", 1)], 12) == {"a": 5, "b": 6, "c": 1}
    assert M.plan_quotas([("a", 2), ("b", 100)], 50) == {"a": 1, "b": 49}
    assert M.plan_quotas([("a", 2)], 50) == {"a": 2}
    assert M.plan_quotas([], 5) == {} and M.plan_quotas([("a", 3)], 0) == {"a": 0}


@pytest.mark.parametrize("n", [0, 1, 17, 60, 500])
def test_stratified_sample_fills_its_quota(spark, n):
    df = spark.range(60).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")).alias("s"))
    got = M.stratified_sample(df, "s", "k", n)
    assert got.count() == min(n, 60) and got.select("k").distinct().count() == min(n, 60)
    assert n == 0 or got.where("s IS NULL").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_quotas_of_a_table_equal_those_of_a_list(spark, seed):
    """Rounds of slack, odd ones in order of appearance, and excess off the largest."""
    rnd = random.Random(seed)
    sizes = [(f"s{i}", rnd.choice([1, 1, 2, 3, 5, 8, 40, 400]), rnd.random()) for i in range(rnd.choice([1, 7, 300]))]
    sizes.sort(key=lambda r: r[2])
    whole = sum(n for _, n, _ in sizes)
    for n in {0, 1, whole // 7, whole // 2 + 1, whole - 1, whole + 3} if seed % 2 else {rnd.randint(1, whole), len(sizes) // 2 + 1}:
        table = spark.createDataFrame(sizes, "stratum string, n long, first double")
        assert dict(map(tuple, M.plan_quota_table(table, n).collect())) == M.plan_quotas([r[:2] for r in sizes], n)


def test_many_strata_never_meet_in_the_driver(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("s"), (F.col("id") % 700).cast("string")).alias("stratum"))
    want = sorted(map(tuple, M.stratified_sample(df, "stratum", "k", 1000).collect()))
    monkeypatch.setattr(M, "MANY_STRATA", 20)
    monkeypatch.setattr(M, "plan_quotas", None)
    got = sorted(map(tuple, M.stratified_sample(df, "stratum", "k", 1000).collect()))
    assert got == want and len(got) == 1000


def _pictures(spark):
    rows = [(i, [c for c in "abcdef" if (i >> "abcdef".index(c)) & 1]) for i in range(64)] + [(64, list("abcdef"))]
    images = spark.createDataFrame(rows, "image_id long, cats array<string>")
    weights = {c: 6 - k for k, c in enumerate("fedcba")}  # f is the most popular
    pairs = spark.createDataFrame([(i, c) for i, cats in rows for c in cats] + [(100 + j, c) for c, w in weights.items() for j in range(w)], "image_id long, cat string")
    return rows, images, pairs, spark.createDataFrame([(c,) for c in "abcdefg"], "cat string")


def test_negatives_equal_a_search_of_the_vocabulary(spark):
    rows, images, pairs, cats = _pictures(spark)
    held: dict = {}
    for i, c in {tuple(r) for r in pairs.collect()}:
        held.setdefault(i, set()).add(c)
    beside = lambda a: sorted((c for c in "abcdef" if c != a and any({a, c} <= h for h in held.values())), key=lambda c: (-sum({a, c} <= h for h in held.values()), c))
    got = {r.image_id: r for r in M.negatives(images, pairs, cats).collect()}
    assert len(got) == len(rows)
    for i, own in rows:
        popular = next(c for c in "fedcbag" if c not in own)
        near = next((c for c in (beside(own[0]) if own else []) if c not in own), popular)
        assert (got[i].popular, got[i].cooccur) == (popular, near)
        assert got[i].random not in own and got[i].random in "abcdefg"
    assert len({got[i].random for i, own in rows if not own or own == ["a"]} | {r.random for r in got.values()}) > 4
    full = spark.createDataFrame([(1, list("abcdefg"))], "image_id long, cats array<string>")
    assert tuple(M.negatives(full, pairs, cats).first())[2:] == (None, None, None)


def test_first_gap(spark):
    rows = [([],), ([1],), ([2],), ([1, 2, 3],), ([1, 3, 4],), ([1, 2, 9],)]
    got = spark.createDataFrame(rows, "r array<int>").select(M.first_gap(F.col("r")).alias("g")).collect()
    assert [r.g for r in got] == [1, 2, 1, 4, 2, 3]


def test_quota_sampler_keeps_its_promises(spark):
    rows, images, pairs, cats = _pictures(spark)
    got = M.quota_sampler(images, pairs, cats, 20, {"random": 8, "popular": 6, "cooccur": 6}).collect()
    have = dict(rows)
    assert sum(r.gold == "yes" for r in got) == 20
    assert all((r.category in have[r.image_id]) == (r.gold == "yes") for r in got)
    assert {k: sum(r.neg_type == k for r in got) for k in ("random", "popular", "cooccur")} == {"random": 8, "popular": 6, "cooccur": 6}
    assert all(r.category == next(c for c in "fedcbag" if c not in have[r.image_id]) for r in got if r.neg_type == "popular")


def test_last_and_first_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 1, "n")], "k string, o int, v string")
    assert {(r.k, r.v) for r in W.keep_last(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", None), (None, "n")}
    assert {(r.k, r.v) for r in W.keep_first(df, ["k"], ["o"]).collect()} == {("a", "x"), ("b", None), (None, "n")}


def test_reject_reasons_come_in_order(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 5), (0, 0)], "a int, b int")
    got = {r.reason: r.n for r in P.reject_counts(df, [("a", F.col("a") == 1), ("b", F.col("b") == 1)]).collect()}
    assert got == {"kept": 1, "b": 1, "a": 2}


def test_token_sums(spark):
    rows = [(s, t, t < n, 2.0, -1.0, "ce" if s in (1, 3) else "kl") for s, n in enumerate((5, 7, 2, 8)) for t in range(8)]
    df = spark.createDataFrame(rows, "sample_id int, t int, mask boolean, raw_kl double, log_prob double, loss_branch string").withColumns({"weight": F.lit(1.0), "beta": F.lit(0.1)})
    r = G.batch_sums(df).first()
    assert (r.kl_sum, r.ce_samples) == (14.0, 2)
    assert r.ce_sum == pytest.approx(1.5) and r.kl_ce_ratio == pytest.approx(14 / 15.5)
    off = T.recipe_loss(df, "filtered").agg(F.sum("loss").alias("x")).first().x
    assert off == pytest.approx(15.5)
    with pytest.raises(KeyError):
        T.recipe_loss(df, "other")


def test_delta_weights(spark):
    df = spark.createDataFrame([(1, float(x), m) for x, m in ((5, True), (3, True), (1, True), (0.5, True), (99, False))] + [(2, 7.0, False)], "b int, delta double, mask boolean")
    got = T.delta_weights(df, "b").collect()
    assert sum(r.weight for r in got if r.mask) / 4 == pytest.approx(1.0)
    assert [r.weight for r in got if r.b == 2] == [1.0]


def test_weighted_nll_needs_equal_lengths(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    df = spark.range(1)
    assert df.select(T.weighted_nll(arr(-1, -2), arr(2, 3), F.lit(True)).alias("w")).first().w == [2.0, 6.0]
    assert df.select(T.weighted_nll(arr(-1, -2), arr(2, 3), F.lit(False)).alias("w")).first().w == [0.0, 0.0]
    with pytest.raises(Exception, match="differ in length"):
        df.select(T.weighted_nll(arr(-1), arr(2, 3), F.lit(True)).alias("w")).collect()


@pytest.mark.parametrize(("acc", "prior", "want"), [(0.80, 0.9, "FAIL too easy"), (0.5, None, "FAIL weak prior"), (0.5, 0.30, "PASS"), (None, 0.5, "INCONCLUSIVE")])
def test_synth_gate(spark, acc, prior, want):
    df = spark.createDataFrame([(acc, prior)], "a double, p double")
    assert df.select(gates.synth_verdict(F.col("a"), F.col("p")).alias("v")).first().v == want


def test_health_findings(spark):
    rows = [(1, "actor/loss", 500.0), (2, "actor/loss", 1.0), (2, "actor/e1_v1/kl_ce_ratio", float("nan")), (2, "other", 1.0)]
    got = {r.metric: r.severity for r in gates.health_findings(spark.createDataFrame(rows, "step long, metric string, value double"), gates.HEALTH_RULES, "C").collect()}
    assert got == {"actor/loss": "ok", "actor/e1_v1/kl_ce_ratio": "fail"}


def test_gate_codes_and_settings():
    assert (gates.gate_code(0), gates.gate_code(3), gates.gate_code(0, True)) == (0, 1, 2)
    assert config.read_settings("kl_ce_band: [0.2, 0.8]\nskip: a, b").skip == ("a", "b")
    with pytest.raises(KeyError):
        config.read_settings("nope: 1")


def test_scans_and_errors(spark):
    path = scratch(spark, "t")
    spark.createDataFrame([('{"error": null, "sample_id": "a"}\n',), ('{"error": "", "sample_id": "b"}',), ('{"error": "x", "sample_id": "c"}',)], "v string").write.text(path)
    ids = lambda mode: {r.sample_id for r in R.load_records(spark, path, "sample_id string, error string", mode).collect()}
    assert ids("present") == {"a"} and ids("truthy") == {"a", "b"}
    with pytest.raises(ValueError):
        ids("other")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.load_records(spark, path + "-none", "error string").count()
    assert R.shard_paths(spark, path, "none") == []


def test_sinks(spark):
    with pytest.raises(ValueError):
        K.write_train(spark.range(0), scratch(spark, "t"))
    assert "| x | - |" in K.markdown(spark.createDataFrame([("x", None)], "a string, b int"), "T")
    with pytest.raises(ValueError):
        K.markdown(spark.range(5), "T", limit=3)
    counts, code = K.write_findings(J.leak_findings(spark.createDataFrame([(1, 2)], "t int, e int"), "id", "t", "e", F.lit(0)), scratch(spark, "t"))
    assert (counts.first().n, code) == (1, 1)


def test_unknown_names_raise(spark):
    with pytest.raises(KeyError):
        R.Registry().load("none")
    with pytest.raises(KeyError):
        R.sample_vlmbias(spark.range(1), "none")


def test_identity_escapes_nothing(spark):
    rows = [(str(i), str(i % 3), i % 2 == 0, str(i % 4), str(i % 3), i % 2 == 0) for i in range(30)]
    df = spark.createDataFrame(rows, "sample_id string, answer string, correct boolean, gold string, s_answer string, s_correct boolean").withColumns({"b_answer": F.col("s_answer"), "b_correct": F.col("s_correct")})
    assert G.inheritance(df).first().escaped == 0


def test_log_stream(spark, tmp_path):
    logs_dir, table = tmp_path / "logs", f"file://{tmp_path}/table"
    logs_dir.mkdir()
    (logs_dir / "a.log").write_text("x training/global_step: 1 actor/loss=2.0\nx training/global_step: 2 actor/loss=4.0\n")
    q = logs.follow_ranges(spark, str(logs_dir), table)
    q.processAllAvailable()
    q.stop()
    got = {r.metric: (r.min, r.max, r.last) for r in logs.followed_ranges(spark, table).collect()}
    assert got["actor/loss"] == (2.0, 4.0, 4.0)


@pytest.mark.parametrize("limit", [1, 2, 5, 6, 9, 12])
def test_hamming_pairs_equal_all_pairs(spark, limit):
    rnd = random.Random(limit)
    base = [rnd.getrandbits(64) for _ in range(40)]

    def near(x):
        for b in rnd.sample(range(64), rnd.randint(0, 9)):
            x ^= 1 << b
        return x

    sides = [[near(x) for x in base for _ in range(3)] for _ in range(2)]
    left, right = (spark.createDataFrame([(i, h - 2**64 if h >= 2**63 else h) for i, h in enumerate(s)], f"{name} long, h long") for s, name in zip(sides, ("lid", "rid")))
    got = sorted(map(tuple, hamming_pairs(left, right, limit).collect()))
    assert got == sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1]) if (a ^ b).bit_count() < limit)


def _even(n, seed):
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def test_parts_cover_the_distance_and_large_sides_get_wide_ones():
    from math import comb

    a, b = _even(4000, 1), _even(4000, 2)
    emits = lambda plan: sum(sum(comb(w, r) for r in range(t + 1)) for _, w, t in plan)
    for distance in range(0, 16):
        for n, m in ((10, 10), (5_000, 5_000), (10**5, 10**8), (10**8, 10**8)):
            plan = plan_parts(n, m, distance, a, b)
            assert sum(t + 1 for *_, t in plan) > distance and [at for at, *_ in plan] == [sum(w for _, w, _ in plan[:i]) for i in range(len(plan))]
            assert sum(w for _, w, _ in plan) == 64
    few, many = plan_parts(5_000, 5_000, 4, a, b), plan_parts(10**5, 10**8, 4, a, b)
    assert emits(few) <= 8 and len(many) < len(few)


def test_skewed_bits_get_small_thresholds():
    a, b = _even(4000, 1), _even(4000, 2)
    a, b = a & ~np.uint64(0xFFFFFF), b & ~np.uint64(0xFFFFFF)  # the low bits of all rows agree
    plan = plan_parts(10**6, 10**6, 6, a, b)
    assert plan[0][2] <= min(t for *_, t in plan[1:]) and max(t for *_, t in plan) >= 1


def test_hamming_pairs_of_one_hot_hash_nulls_and_sides_of_any_size(spark):
    rnd = random.Random(2)
    left = [(i, 7 if i < 40 else rnd.getrandbits(63)) for i in range(120)] + [(500, None)]
    right = [(i, 7 ^ (1 << i)) for i in range(6)] + [(9, None), (10, -1), (11, 7), (11, 7)]
    want = sorted((i, j, ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in left for j, b in right if a is not None and b is not None and ((a ^ b) & (2**64 - 1)).bit_count() < 8)
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, h long")
    assert sorted(map(tuple, hamming_pairs(make(left, "lid"), make(right, "rid"), 8).collect())) == want
    swapped = sorted((r.rid, r.lid, r.distance) for r in hamming_pairs(make(right, "lid"), make(left, "rid"), 8).collect())
    assert swapped == want
    assert hamming_pairs(make(left, "lid"), make(right, "rid").limit(0), 8).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_allocation_of_rows_equals_that_of_a_dict(spark, n):
    for weights in ({"a": 0.4, "b": 0.3, "c": 0.3}, {"x": 1.0}, {"a": 1.0, "b": 1.0, "c": 3.0, "d": 0.5, "e": 2.0}):
        rows = spark.createDataFrame([*weights.items(), (None, 3.0), ("zz", None)], "topic string, weight double")
        assert dict(map(tuple, M.allocate_rows(rows, n).collect())) == M.allocate(weights, n)


@pytest.mark.parametrize("group_rows", [0, 300, 10**6])
def test_percentiles_equal_a_sort(spark, group_rows):
    """Groups through ranges and through one aggregate; ties, one value that most rows have, tiny groups, infinities and nulls."""
    from siftwell.functions.stats import percentiles

    rnd = random.Random(group_rows)
    draw = {"even": lambda: rnd.random(), "ties": lambda: float(rnd.randrange(4)), "hot": lambda: 5.0 if rnd.random() < 0.7 else rnd.gauss(5, 1), "odd": lambda: rnd.choice([float("inf"), -1.0, None, 2.0]), None: lambda: rnd.gauss(0, 100)}
    rows = [(g, f()) for g, f in draw.items() for _ in range(500)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    ps = {"low": 0, "p37": 37, "mid": 50, "p95": 95, "high": 100}
    got = {r.g: tuple(r[p] for p in ps) for r in percentiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], ps, group_rows).collect()}
    groups: dict = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        values.sort()
        for p, x in zip(ps.values(), got[g]):
            at = p / 100 * (len(values) - 1)
            lo, hi = values[int(at)], values[min(int(at) + (at > int(at)), len(values) - 1)]
            assert x == pytest.approx(lo if lo == hi else lo + (hi - lo) * (at - int(at))), (g, p)


def test_containing_equals_all_pairs(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abc")
    texts = ["".join(word() + rnd.choice(["", " ", "  ", "\n"]) for _ in range(60)) for _ in range(60)] + [None, "", " "]
    items = [t[i : i + n] for t in texts[:30] for i, n in ((3, 25), (0, 60), (7, 4), (11, 33))] + [None]
    docs, found = spark.createDataFrame(list(enumerate(texts)), "d long, text string"), spark.createDataFrame(list(enumerate(items)), "i long, item string")
    got = sorted((r.d, r.i) for r in J.containing(docs, found, "text", "item").collect())
    assert got == [(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t is not None and x is not None and x in t]


def test_dct_hash_keeps_under_scaling_and_noise():
    rnd = np.random.default_rng(1)
    images = [np.kron(rnd.random((8, 8)), np.ones((20, 26))) for _ in range(6)]
    hashes = [pluggable.dct_hash(x) for x in images]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(-(2**63) <= h < 2**63 for h in hashes)
    for x, h in zip(images, hashes):
        assert apart(pluggable.dct_hash(x[::2, ::2]), h) < 5 and apart(pluggable.dct_hash(x * 0.8 + 0.02 * rnd.random(x.shape)), h) < 5
    assert min(apart(a, b) for i, a in enumerate(hashes) for b in hashes[:i]) > 10
    wave = np.cos(np.pi * np.arange(32) * 3 / 32 + np.pi * 3 / 64)
    bits = pluggable.dct_hash(np.ones((32, 1)) * wave) & (2**64 - 1)
    assert bits >> 60 & 1  # the frequency that is there, third of the first row
    with pytest.raises(ValueError):
        pluggable.dct_hash(np.zeros((0, 4)))


def test_a_followed_log_has_the_ranges_of_the_whole(spark, tmp_path):
    """After every micro-batch; steps come again with other values, also such that no number remains."""
    from siftwell.operators.aggregates import metric_ranges

    rnd = random.Random(4)
    value = lambda: rnd.choice(["nan", "inf", f"{rnd.randrange(40)}.5", f"-{rnd.randrange(9)}e1"])
    lines = [f"step training/global_step: {rnd.randrange(30)} actor/loss={value()} perf/x{i % 3}={value()}" for i in range(120)] + ["training/global_step: 99 actor/loss=7.0", "no step"]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.log").write_text("\n".join(lines[41 * k : 41 * k + 41]) + "\n")
        q = logs.follow_ranges(spark, str(folder), str(tmp_path / "table"))
        q.processAllAvailable()
        q.stop()
        whole = spark.createDataFrame(list(enumerate(lines[: 41 * k + 41])), "line_no long, line string")
        want = metric_ranges(logs.last_by_step(logs.log_series(whole)))
        got = {r.metric: (r.min, r.max, pytest.approx(r.mean), r["last"], r.n) for r in logs.followed_ranges(spark, str(tmp_path / "table")).collect()}
        assert {r.metric: (r.min, r.max, r["mean"], r["last"], r.n) for r in want.collect()} == got != {}
    rows = sorted((tmp_path / "table").glob("epoch=*"))
    assert len(rows) == 3 and spark.read.parquet(str(tmp_path / "table")).count() <= 3 * 5  # a row a metric and batch, not the history
