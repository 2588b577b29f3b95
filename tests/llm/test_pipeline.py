"""The corpus pipeline against its stages done one document at a time."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from siftwell.llm import pii, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    score, spans = toxicity.fit(docs, labels).scorer(), pii.PiiModel().spans
    left = {r.doc_id: r.text for r in docs.collect() if score(r.text) < 0.5}
    ids = sorted(left)
    group = brute.wide_components(ids, [left[i] for i in ids])
    left = {i: left[i] for i, g in zip(ids, group) if i == g}
    dirty = {d for d, t in left.items() if any(t_ in t for _, t_ in items)}
    exact = {d for d, _ in brute.leaks([(d, left[d]) for d in dirty], items)}
    assert exact == dirty
    left = {d: pii.redact_text(t, spans(t)[1]) for d, t in left.items() if d not in dirty}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: tok.encode(t, add_special_tokens=False).ids + [1] for d, t in left.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert r.ids_crc32 == brute.crc_ids(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
    brute.padding((r.sequence_id, r.offset, r.length) for r in got)


def test_stages_return_the_columns_of_documents(spark, docs, messy):
    rows = messy
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, rows, SF)
        assert out.columns == messy.columns, name
        rows = out
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() > 0


def test_stages_on_an_empty_table(spark, none):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, SF).count() == 0
