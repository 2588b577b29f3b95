"""Token files and packing: round trips, equality with the library, gapless packs, messy tables."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftwell.llm import packing as P
from siftwell.llm import token_files as T
from siftwell.llm.common import fresh_path
from siftwell.llm.queries import op5_token_files, op6_packing
from tests.llm import brute
from tests.llm.conftest import SF


def _texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    letters = " \n\t aAbZ'sß.!#1９é\x1cİΣσ\xa0漢\r\x0b​½\x01|,"
    parts = ["it's", "don't", "a.", "\x01", "x\ny", "foo$$$", "1,", "'s.", "é.", "", "a\n\nb", "\n", "_.", "b_", "<|endoftext|>", "x<|endoftext|>."]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize(("name", "drops"), [(T.BYTE_BPE, False), (P.WORD_BPE, True)])
def test_encoder_equals_the_library(name, drops):
    enc, texts = T.Encoder(public_tokenizers.path(name), drops), _texts(3000, 1)
    for some in (texts[:4000], texts[3000:], texts[:100]):  # the memo is warm from the second on
        ids, counts = enc.encode(pa.array(some))
        want = [e.ids for e in enc.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_op5_equals_the_library(spark, docs):
    got = op5_token_files(spark, SF).orderBy("doc_id").toPandas()
    rows = docs.orderBy("doc_id").toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path(T.BYTE_BPE))
    ids = [e.ids + [2] for e in tok.encode_batch(rows.text.tolist(), add_special_tokens=False)]
    n = np.array([len(x) for x in ids])
    assert got.doc_id.tolist() == rows.doc_id.tolist() and got.n_tokens.tolist() == n.tolist()
    assert got.start.tolist() == (np.cumsum(n) - n).tolist() and got.ids_crc32.tolist() == [brute.crc_ids(x) for x in ids]


def test_files_are_fixed_size_streams(spark, docs):
    folder = fresh_path(spark, "t")
    manifest = T.write_token_files(docs, folder, public_tokenizers.path(T.BYTE_BPE), 2, seq_len=64)
    whole = 0
    for r in manifest.where("n_docs > 0").collect():
        f = T.TokenFile(folder, r.name)
        masks = [f.sequence(k) for k in range(f.starts[-1] // 64)]
        assert all(len(ids) == len(mask) == 64 for ids, mask in masks)
        assert sum(int(mask.sum()) for _, mask in masks) == r.n_tokens
        assert all(mask.all() for _, mask in masks[:-1])
        flat = np.concatenate([ids for ids, _ in masks])
        at, n = (f.index.column(c).to_numpy() for c in ("at", "n_tokens"))
        assert all((f.ids(int(a), int(k)) == flat[a : a + k]).all() for a, k in zip(at, n))
        whole += r.n_docs
    assert whole == docs.count()


def test_op5_on_messy_rows(messy, none):
    rows = T.token_digests(messy).collect()
    assert len(rows) == messy.count() and min(r.start for r in rows) == 0
    empty = {r.n_tokens for r in rows if r.doc_id in (3, 4)}
    assert empty == {1} and sum(r.doc_id == 2 for r in rows) == 2
    assert T.token_digests(none).count() == 0


def _check_packs(rows, texts: dict) -> tuple[int, int]:
    tok = Tokenizer.from_file(public_tokenizers.path(P.WORD_BPE))
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    at = dict.fromkeys(texts, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == brute.crc_ids(ids[r.doc_id][r.start : r.start + r.length])
        at[r.doc_id] += r.length
    assert all(at[d] == len(x) for d, x in ids.items())
    return brute.padding((r.sequence_id, r.offset, r.length) for r in rows)


def test_op6_packs_all_with_little_padding(spark, docs):
    got = op6_packing(spark, SF).collect()
    total, pad = _check_packs(got, {r.doc_id: r.text for r in docs.collect()})
    assert pad <= max(2048, 0.02 * total)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rnd = random.Random(seed)
    seq = rnd.choice([16, 64, 2048])
    histogram = {rnd.randint(1, seq): rnd.randint(1, 500) for _ in range(rnd.randint(1, 40))}
    seen, used = {}, {}
    for length, first, n, each, sequence, at in P.plan_packs(histogram, seq):
        assert n % each == 0
        for r in range(n):
            assert seen.setdefault((length, first + r), 1)
            seen[length, first + r] = 0
            used.setdefault(sequence + r // each, []).append((at + r % each * length, length))
    assert set(seen) == {(k, r) for k, n in histogram.items() for r in range(n)}
    for parts in used.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= seq
    need = -(-sum(k * n for k, n in histogram.items()) // seq)
    assert len(used) <= 1.7 * need + 1


def test_op6_on_messy_rows(messy, none):
    rows = P.pack_documents(messy).collect()
    sums = {}
    for r in rows:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums[3] == sums[4] == 1 and sums[2] == 2 * sums[1]
    brute.padding((r.sequence_id, r.offset, r.length) for r in rows)
    assert P.pack_documents(none).count() == 0
