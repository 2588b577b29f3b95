"""The language network: gradients, batches against one byte at a time, what it learns from, and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import language_id as L
from siftwell.llm.queries import op12_language_id
from tests.llm.conftest import SF


def test_gradients_equal_differences():
    rnd = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in L.init(3, hidden=4, seed=2).items()}
    x, there = L._grid([bytes(rnd.integers(0, 256, n).astype(np.uint8)) for n in (64, 5, 40, 1)])
    label = np.array([0, 2, 1, 1])
    _, g = L.gradients(p, x, there, label)
    for name, v in p.items():
        for at in [tuple(rnd.integers(0, s) for s in v.shape) for _ in range(6)] + ([(2, int(x[0, 0]))] if name.startswith("in_") else []):
            old, h = v[at], 1e-2
            around = []
            for d in (h, -h):
                v[at] = old + d
                around.append(L.gradients(p, x, there, label)[0])
            v[at] = old
            assert g[name][at] == pytest.approx((around[0] - around[1]) / (2 * h), abs=2e-4), (name, at)


def one_by_one(p, text: bytes) -> np.ndarray:
    """Mean probabilities of a text, a byte and a window at a time."""
    soft = lambda v: v / (1 + np.abs(v))
    k = p["rec_f"].shape[1]
    total = np.zeros(len(p["out"]))
    for s in range(0, len(text), L.WINDOW):
        w = text[s : s + L.WINDOW]
        states = {}
        for d, order in (("f", range(len(w))), ("b", range(len(w) - 1, -1, -1))):
            h = np.zeros(k)
            for t in order:
                g, a = p[f"in_{d}"][:, w[t]], p[f"rec_{d}"] @ h
                z, r = (soft(g[i * k : (i + 1) * k] + a[i * k : (i + 1) * k]) / 2 + 0.5 for i in (0, 1))
                new = soft(g[2 * k :] + r * (a[2 * k :] + p[f"bias_{d}"][:, 0]))
                h = new + z * (h - new)
                states[d, t] = h
        for t in range(len(w)):
            y = p["out"] @ np.concatenate([states["f", t], states["b", t]]) + p["shift"][:, 0]
            total += np.exp(y - y.max()) / np.exp(y - y.max()).sum()
    return total / max(len(text), 1)


def test_batches_equal_one_byte_at_a_time(monkeypatch):
    monkeypatch.setattr(L, "AT_ONCE", 3)
    rnd = np.random.default_rng(3)
    p = L.init(4)
    texts = [bytes(rnd.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 63, 64, 65, 500, 128)]
    pooled = L.LanguageModel(list("abcd"), p).pooled(texts)
    assert np.allclose(pooled, [one_by_one(p, t) for t in texts], atol=1e-5)


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{SF}/documents.parquet"), 200)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = op12_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(both) == docs.count()
    assert (both.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in both.doc_id]).all()
    assert (both.lang == both.lang_pred)[both.held_out].mean() >= 0.97
    assert both.score.between(0, 1).all()


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, L.training_windows(d).collect())) for d in (docs, other))
    assert a == b


def test_nulls_letterless_texts_and_the_like(spark, messy, none, model):
    out = {}
    for r in L.identify(messy, model).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert len(out[2]) == 2 and len(out[None]) == 2 and out[2][0] == out[2][1]
    for d in (3, 4, 5):
        assert (out[d][0].lang_pred, out[d][0].score) == ("und", 0.0)
    assert out[1][0].lang_pred == "en" and out[8][0].lang_pred in model.names and out[9][0].lang_pred in model.names
    assert L.predict_languages(messy).count() == messy.count()
    assert L.predict_languages(none).count() == 0
    odd = spark.createDataFrame([(1, "123 456 ½ ²Ⅷ _ 7"), (2, "漢"), (3, "7 ª")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in L.identify(odd, model).orderBy("doc_id").collect()] == [True, False, False]


def test_few_languages(spark):
    docs = spark.createDataFrame([(i, f"some text {i}", "en" if i % 2 else None, ) for i in range(20)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.predict_languages(docs).collect()} == {("en", 1.0)}
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in L.predict_languages(unknown).collect()} == {("und", 0.0)}


def test_every_byte_is_labelled(spark, messy, model):
    text = {(r.doc_id, r.text) for r in messy.collect()}
    rows = L.label_bytes(messy, model).collect()
    assert len(rows) == messy.count()
    sizes = sorted(len((t or "").encode()) for d, t in text)
    assert sorted({r.runs[-1].end if r.runs else 0 for r in rows}) == sorted(set(sizes))
    for r in rows:
        assert all(a.end == b.start and a.lang != b.lang for a, b in zip(r.runs, r.runs[1:]))
        assert not r.runs or r.runs[0].start == 0
    en = spark.createDataFrame([(1, "The and this of that with it is there in the. " * 20)], "doc_id long, text string")
    runs = L.label_bytes(en, model).first().runs
    assert sum(x.end - x.start for x in runs if x.lang == "en") > 0.7 * runs[-1].end
