"""Operators on what a narrower search would pass by."""

import random

import pytest

from siftwell.llm import html_extract as H
from siftwell.llm import pii
from siftwell.llm import simhash_dedup as S
from tests.llm import brute


def _wide_brute(ids: list, texts: list, searched: int, limit: int = 64) -> list:
    """Least id reachable over links of the wide fingerprints, by trying all pairs."""
    f = [brute.wide_prints(t) for t in texts]
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in range(i):
            apart = [(a ^ b).bit_count() for a, b in zip(f[i], f[j])]
            if apart[0] <= 3 or sum(apart) <= limit and any(((a ^ b) >> s & 0xFFFFFFFF).bit_count() <= 2 for a, b in zip(f[i][:searched], f[j]) for s in (0, 32)):
                root[find(i)] = find(j)
    least: dict = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(f))]


def _copies(seed: int, families: int = 12, most: int = 14, edits: int = 7, length: int = 160) -> list:
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 300))
    texts: list = [None, "", "one", "One", "a few words"]
    for _ in range(families):
        base = [word() for _ in range(rnd.randint(30, length))]
        for _ in range(rnd.randint(1, most)):
            copy = list(base)
            for _ in range(rnd.randint(0, edits)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def _table(spark, texts):
    return spark.createDataFrame(list(zip(range(10, 10 + len(texts)), texts)), "doc_id long, text string")


def test_loose_dedup_searches_five_words(spark):
    texts = _copies(9)
    ids = list(range(10, 10 + len(texts)))
    want = _wide_brute(ids, texts, 5)
    assert want != _wide_brute(ids, texts, 2)
    assert sorted(r.doc_id for r in S.drop_loose_duplicates(_table(spark, texts)).collect()) == sorted(set(want))


def test_links_of_a_group_are_verified_before_nodes_are_absorbed(spark):
    """A family of texts that share most words but are no copies of each other: by one word alone many go to the same root."""
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 3000))
    base = [word() for _ in range(400)]
    texts: list = []
    for k in range(300):
        own = list(base)
        for at in rnd.sample(range(400), 10):
            own[at] = word()
        texts.append(" ".join(own))
        if k % 3 == 2:
            for at in rnd.sample(range(400), 7):
                own[at] = word()
            texts.append(" ".join(own))
    ids = list(range(10, 10 + len(texts)))
    want = _wide_brute(ids, texts, S.SEARCHED)
    got = {r.doc_id: r.component_id for r in S.wide_components(_table(spark, texts)).collect()}
    assert [got[i] for i in ids] == want and len(set(want)) > 100


@pytest.mark.parametrize("bound", [4096, 40, 4, 1])
def test_wide_components_equal_brute_force_at_any_bound(spark, bound):
    texts = _copies(5, 8, 30, 12, 120)
    ids = list(range(10, 10 + len(texts)))
    got = {r.doc_id: r.component_id for r in S.wide_components(_table(spark, texts), group_bound=bound).collect()}
    assert [got[i] for i in ids] == _wide_brute(ids, texts, S.SEARCHED)


def test_a_card_late_in_a_table_of_numbers_is_proposed():
    text = "7 " * 80 + "3782 822463 10005"
    dropped = [(k, a, b) for k, a, b, good in pii.base_matches(text) if not good]
    assert ("card", 160, 177) in set(pii.candidates(text, dropped))
    rnd = random.Random(1)
    pii.PiiModel().spans(" ".join(str(rnd.randint(0, 9)) for _ in range(100_000)))  # stays linear


def _extract(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in H.extract_text(df).orderBy("page_id").collect()]


def test_a_template_node_with_a_text_of_its_own_stays(spark):
    page = lambda head, i: f"<body><div>{head}</div><p>Story number {i}</p></body>"
    got = _extract(spark, [*(page("Welcome to our site", i) for i in range(19)), page("Closed on Monday", 19)])
    assert got == [*(f"Story number {i}" for i in range(19)), "Closed on Monday\n\nStory number 19"]


def test_copies_of_a_page_count_once(spark):
    page = lambda i, more="": f"<body><p>First of {i}</p><p>Second of {i}</p>{more}</body>"
    got = _extract(spark, [page(0)] * 60 + [page(1, "<ul><li>A note</li></ul>")])
    assert got[-2:] == ["First of 0\n\nSecond of 0", "First of 1\n\nSecond of 1\n\nA note"]
