"""Near-duplicates and decontamination against brute force, and on messy tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import decontaminate as D
from siftwell.llm import simhash_dedup as S
from siftwell.llm.queries import op1_simhash_near_dedup, op2_decontamination
from tests.llm import brute
from tests.llm.conftest import SF


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op1_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").orderBy("doc_id").toPandas()
    got = op1_simhash_near_dedup(spark, f"/root/testdata/{sf}").orderBy("doc_id").toPandas()
    prints = [brute.simhash(t) for t in docs.text]
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == brute.components(docs.doc_id.tolist(), prints)


def _swarm(n: int, seed: int) -> list[int]:
    rnd = random.Random(seed)
    hubs = [rnd.getrandbits(64) for _ in range(4)]
    out = {rnd.getrandbits(64) for _ in range(n // 4)}
    while len(out) < n:
        h = rnd.choice(hubs)
        for b in rnd.sample(range(64), rnd.randint(0, 7)):
            h ^= 1 << b
        out.add(h)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("bound", [4096, 3])
def test_components_of_a_swarm(spark, radius, bound):
    """With a bound of 3 nearly all links come from the full ball."""
    prints = _swarm(500, radius)
    ids = list(range(100, 100 + len(prints)))
    df = spark.createDataFrame(list(zip(ids, np.array(prints, np.uint64).view(np.int64).tolist())), "doc_id long, fp long")
    got = {r.fp & (2**64 - 1): r.component_id for r in S.components(df, radius=radius, group_bound=bound).collect()}
    assert [got[p] for p in prints] == brute.components(ids, prints, radius)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long")
    assert {r.b for r in S.connected(edges).collect()} == {0}


def test_op1_on_messy_rows(messy, none):
    rows = S.simhash_components(messy).collect()
    assert len(rows) == messy.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1
    assert {by[i].fingerprint for i in (3, 4, 5)} == {"0" * 16} and {by[i].component_id for i in (3, 4, 5)} == {3}
    assert by[6].component_id == by[7].component_id == 6
    assert sorted((r.component_id is None) for r in rows if r.doc_id is None) == [False, True]
    assert S.simhash_components(none).count() == 0


def test_dedup_keeps_one_of_each_group(messy, none):
    kept = S.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 8, 9]
    assert kept.where("doc_id IS NULL").count() == 2
    assert S.drop_near_duplicates(none).count() == 0


def _edited(text: str, at: int) -> str:
    w = text.split(" ")
    return " ".join([*w[:at], "changed", *w[at + 1 :]])


@pytest.mark.parametrize("bound", [4096, 40])
def test_wide_components_equal_brute_force(spark, bound):
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 300))
    texts: list = [None, "", "one", "One", "a few words"]
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(30, 160))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, 7)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    ids = list(range(10, 10 + len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.wide_components(df, group_bound=bound).collect()}
    want = brute.wide_components(ids, texts)
    assert [got[i] for i in ids] == want and len(set(want)) > 12


def test_of_rows_that_repeat_an_id_the_same_one_stays(spark):
    rows = [(1, "b text of its own here"), (1, "a text of its own here"), (2, "quite another one of four or more"), (None, "x")]
    for part in (rows, rows[::-1]):
        kept = S.drop_loose_duplicates(spark.createDataFrame(part, "doc_id long, text string")).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "x"), (1, "a text of its own here"), (2, "quite another one of four or more")]


def test_hubs_keep_their_component(spark, monkeypatch):
    monkeypatch.setattr(S, "HUB", 5)
    monkeypatch.setattr(S, "HUBS", 10_000)
    edges = [(i, i % 3) for i in range(10, 100)] + [(200, 99), (0, 1000), (1000, 1)]
    got = {r.a: r.b for r in S.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 2} and len(got) == 93 and got[200] == 0 and got[1] == 0


def test_texts_meet_the_ids_that_stay_in_the_same_way_at_any_size(spark):
    """The ids that stay grow with the documents; where few were broadcast, disk at a small size said nothing of that at a large one."""
    kept = S.drop_loose_duplicates(spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', 'text', id, id * 7, id * 31, 'of its own') AS text"))
    assert kept.count() == 300
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftSemi" in plan and "BroadcastHashJoin" not in plan


def test_rounds_release_what_they_shuffled_and_linked_swarms_cost_no_search(spark, monkeypatch):
    """What rounds leave behind stays in the driver's memory; a large meeting point that is one component already isn't searched again."""
    calls, staged = [], []
    monkeypatch.setattr(S, "release_shuffles", lambda spark: calls.append("release"))
    real = S.stage
    monkeypatch.setattr(S, "stage", lambda df, label: (staged.append(label), real(df, label))[1])
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    assert {r.b for r in S.connected(edges, "rounds").collect()} == {0}
    assert len(calls) == staged.count("rounds") - 1 > 2

    big = spark.createDataFrame([(7, i, 2, i % 2) for i in range(6)], "key long, node long, parts long, part long")
    stars = spark.createDataFrame([(i, 0) for i in range(1, 6)], "a long, b long")
    assert S._across(big, stars, 3) is None
    apart = S._across(big, stars.where("a <> 5"), 3).collect()
    assert {frozenset(r.node for r in apart if r.group == g) for g in {r.group for r in apart}} == {frozenset({0, 2, 4, 5}), frozenset({1, 3, 5})}


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    """A round as one plan read its edges some sixty times, and the driver held that plan over and over."""
    scans = []

    def staged(df, label, stage=S.stage):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return stage(df, label)

    monkeypatch.setattr(S, "stage", staged)
    rows = [(i, i + 1) for i in range(20)] + [(1000 + i, 100) for i in range(S.HUB + 50)] + [(1000 + i, 5000 + i) for i in range(0, S.HUB, 3)]
    edges = S.stage(spark.createDataFrame(rows, "a long, b long"), "edges")
    got = {r.a: r.b for r in S.connected(edges, "small-plans").collect()}
    assert set(got.values()) == {0, 100} and len(got) == 20 + S.HUB + 50 + len(range(0, S.HUB, 3))
    assert 0 < max(scans) <= 10


def test_loose_dedup_on_messy_rows(messy, none):
    kept = S.drop_loose_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 8, 9]
    assert S.drop_loose_duplicates(none).count() == 0


def test_op2_equals_brute_force(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").limit(25)
    pairs = [(r.item_id, r.text) for r in items.collect()]
    plain = [(r.doc_id, r.text[:1500]) for r in docs.orderBy("doc_id").limit(40).collect()]
    planted = [(1000 + i, f"some words before {text.upper()} and after") for i, text in pairs[:12]]
    planted += [(2000 + i, f"lead {_edited(text, 0)} {_edited(text, 20)} tail") for i, text in pairs[12:25]]
    planted += [(3000, " ".join(t for _, t in pairs[:3])), (3001, pairs[0][1] + " " + pairs[0][1])]
    rows = plain + planted
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    want = {k: (round(j, 9), s) for k, (j, s) in brute.leaks(rows, pairs).items()}
    assert got == want and len(want) > 20


def test_texts_shorter_than_the_item(spark):
    item = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    w = item.split()
    rows = [(n, " ".join(w[:n])) for n in range(25, 41)] + [(100 + n, " ".join(w[n:])) for n in range(15)] + [(200, " ".join([*w[:20], "x", *w[20:39]]))]
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {k: (round(j, 9), s) for k, (j, s) in brute.leaks(rows, [(1, item)]).items()} and len(got) > 10


@pytest.mark.parametrize(("words", "share", "recall"), [(14, 0.02, 1.0), (36, 0.03, 1.0), (59, 0.04, 0.99), (300, 0.06, 0.99)])
def test_blocks_prune_and_keep_what_is_similar(spark, words, share, recall):
    """Windows that share as few shingles with their item as a similarity of 0.8 allows, against many other items."""
    rnd = random.Random(words)
    n = words - 4
    lost = int(n * 0.2 / 1.8 + 1e-9)
    rows = []
    for i in range(150):
        grams = [rnd.getrandbits(64) - 2**63 for _ in range(n)]
        window = grams[lost:] + [rnd.getrandbits(64) - 2**63 for _ in range(lost)]
        rows.append((i, words, n, grams, window))
    df = spark.createDataFrame(rows, "item_id long, n_words int, n int, grams array<long>, win array<long>")
    items = D.with_votes(df, "grams").withColumn("fp", D.block_values("counts", "n")).select("item_id", "n_words", "n", "counts", "fp")
    keys = D.item_keys(items, 0.8)
    windows = D.with_votes(df, "win").select(F.col("item_id").alias("w"), F.posexplode(D.block_values("counts", "n")).alias("block", "value"))
    met = windows.join(keys, ["block", "value"]).select("w", "item_id").collect()
    assert len(met) <= share * 150 * 150 + 150 and len(met) == len(set(met))
    assert sum(a == b for a, b in met) >= recall * 150
    assert max(r["count"] for r in keys.groupBy("item_id").count().collect()) <= 2**14


def test_long_and_repetitive_items_lose_no_window(spark):
    """Windows at the least similarity: of shingles that come back, whose votes move together, and of many items of some 60 words."""
    rnd = random.Random(8)
    items, rows = [], []
    for i in range(40):
        same, own = ["a"] * 40, [f"i{i}x{j}" for j in range(60)]
        items.append((i, " ".join(same + own)))
        for j in range(3):
            rows.append((10 * i + j, " ".join(same[10:] + own + [f"t{rnd.random()}" for _ in range(10)])))
        plain = [f"p{i}x{j}" for j in range(59)]
        items.append((100 + i, " ".join(plain)))
        rows += [(1000 + 10 * i + j, " ".join(plain[6:] + [f"t{rnd.random()}" for _ in range(6)])) for j in range(10)]
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    told = dict(items)
    want = {k: (round(j, 9), s) for d, t in rows for k, (j, s) in brute.leaks([(d, t)], [(i, told[i]) for i in [d // 10 if d < 1000 else d // 10]]).items()}
    assert got == want and len(want) == len(rows)


def test_votes_are_those_of_a_simhash(spark):
    rnd = random.Random(2)
    grams = [rnd.getrandbits(64) - 2**63 for _ in range(33)]
    r = D.with_votes(spark.createDataFrame([(grams, 33)], "g array<long>, n int"), "g").select(F.col("counts").alias("c"), D.block_values("counts", "n").alias("b")).first()
    assert r.c[:64] == [sum((x >> i) & 1 for x in grams) for i in range(64)] and len(r.c) == D.BITS
    assert r.b == [sum(1 << i for i in range(16) if 2 * r.c[16 * j + i] > 33) for j in range(D.BITS // D.BLOCK)]


def test_op2_query_finds_whole_passages(spark):
    got = {r.doc_id for r in op2_decontamination(spark, "/root/testdata/sf0.01").collect()}
    head = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").crossJoin(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("text").alias("item"))).where("contains(text, item)")
    assert got >= {r.doc_id for r in head.select("doc_id").distinct().collect()}


def test_short_and_repetitive_items(spark):
    items = spark.createDataFrame([(1, "two words"), (2, "a a a a a a a a"), (3, None), (4, " "), (5, "single")], "item_id long, text string")
    rows = [(1, "here two words stand"), (2, "b a a a a a a a a b"), (3, "a a a"), (4, "a single one"), (5, None), (6, "")]
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {k: (round(j, 9), s) for k, (j, s) in brute.leaks(rows, [(r.item_id, r.text) for r in items.collect()]).items()}


def test_op2_on_messy_rows(spark, messy, none):
    items = spark.createDataFrame([(1, "a short text that is here twice", "x"), (2, None, "x")], "item_id long, text string, key string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(messy, items).collect()} == {(1, 1), (2, 1)}
    kept = D.drop_contaminated(messy, items)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 3
    assert D.find_leaks(none, items).count() == 0 and D.find_leaks(messy, items.limit(0)).count() == 0
    assert D.drop_contaminated(messy, items.limit(0)).count() == messy.count()


def test_native_operators_run_no_python(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = D.find_leaks(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
