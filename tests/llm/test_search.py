"""Ranked search against scoring every document, and the bounds that it prunes by."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [] if text is None else TERM.findall(text.translate(LOWER))


def plain(docs: list, items: list, k: int) -> list:
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    held = [(d, c, sum(c.values())) for d, t in docs if (c := Counter(terms(t)))]
    big_n, big_l = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(terms(text))
        scored = []
        for d, c, n in held:
            m = 75 + (25 * n * big_n) // big_l
            s = sum(times * w[t] * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def tables(spark, docs, items):
    more = {c: F.lit("clash") for c in ("term", "tf", "n", "row", "item", "rank", "score", "w", "part", "terms")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(more), spark.createDataFrame(items, "item_id long, text string").withColumns(more)


def corpus(seed: int, n: int = 300):
    """Zipf-like words, so that some are in almost all documents, with copies, repeats and odd texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{int(300 * rnd.random() ** 3)}"
    docs = [(i, " ".join(word() for _ in range(rnd.randint(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [docs[7], docs[7], (7, "w1 w2"), (None, docs[9][1]), (None, None), (2000, ""), (2001, " .,;\x00 "), (2002, None)]
    docs += [(2003, "Ünï Öß_Öß W1-w1\x7fW2 漢字"), (2004, " ".join(f"w{i % 300}" for i in range(30_000)))]
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 12)))) for i in range(25)]
    items += [items[3], (3, "w5 w5 w5 w299"), (None, "w7 w8"), (30, None), (31, ""), (32, "nowhere nothing"), (33, "ünï öß 漢字 w2"), (34, docs[5][1]), (35, "w0 w0 w0 w0")]
    return docs, items


@pytest.mark.parametrize("seed,k", [(1, 20), (2, 3), (3, 1)])
def test_search_equals_scoring_everything(spark, seed, k):
    docs, items = corpus(seed)
    assert got(S.search(*tables(spark, docs, items), k)) == plain(docs, items, k)


def test_search_without_small_vocabulary(spark, monkeypatch):
    """Beyond the bounds the whole vocabulary is indexed and no side is broadcast."""
    monkeypatch.setattr(S, "SMALL_ROWS", 3)
    docs, items = corpus(4, 80)
    assert got(S.search(*tables(spark, docs, items), 5)) == plain(docs, items, 5)


def test_floors_are_reached_and_prune(spark):
    docs, items = corpus(5, 2000)
    d, i = tables(spark, docs, items)
    k = 10
    want: dict = {}
    for item, _, _, score in plain(docs, items, k):
        want.setdefault(item, []).append(score)
    asked = S.item_terms(i)
    index = S.forward_index(d, asked.select("term").distinct())
    n, total = index.agg(F.count("*"), F.sum("n")).first()
    known, best = S.weighted(asked, index, n, total, k)
    floors = S.thresholds(known, best, index, n, total, k)
    names = {r.item: r.item_id for r in known.select("item", "item_id").distinct().collect()}
    for r in floors.collect():
        assert names[r.item] == 3 or r.floor <= min(want[names[r.item]])  # two items share that id
    gens = S.generators(known, floors)
    assert gens.count() < known.count()
    pairs = S.candidates(gens, index, n, total, k)
    assert pairs.count() < n * len(want) / 4
    assert max(r["count"] for r in pairs.groupBy("item").count().collect()) >= k


def test_ties_rank_by_id(spark):
    docs = [(i, "same words here") for i in (9, 3, 7, 1)] + [(i, "other") for i in range(20, 40)]
    out = S.search(*tables(spark, docs, [(1, "words same")]), 3)
    assert [(r.rank, r.doc_id) for r in out.orderBy("rank").collect()] == [(1, 1), (2, 3), (3, 7)]


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b")], [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert S.search(d, i).count() == 0
