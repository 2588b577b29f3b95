"""Toxicity, quality, personal data, preference formatting, URLs and pages."""

import hashlib
import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import boosting, pii
from siftwell.llm import host_rules as Q
from siftwell.llm import html_extract as H
from siftwell.llm import preference_format as C
from siftwell.llm import toxicity as X
from siftwell.llm import url_rules as U
from siftwell.llm.queries import ORACLES, QUERIES, op3_toxicity, op7_url_rules, op9_pii, op10_html_extraction
from siftwell.queries.base import TABLES
from tests.compare import duck, rows
from tests.llm import brute
from tests.llm.conftest import SF

SF2 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck(SF, TABLES).execute(ORACLES[name]).df()
    assert rows(got) == rows(want) and len(got)


# --- toxicity


@pytest.fixture(scope="module")
def chars(spark):
    return X.CharModel([tuple(r) for r in X.count_trigrams(spark.read.parquet(f"{SF2}/documents.parquet")).collect()])


@pytest.mark.parametrize(("word", "plain"), [("1d10t", "idiot"), ("w0rth1ess", "worthless"), ("sc.u.m", "scum"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("idiiiiot", "idiot"), ("tr@sh", "trash"), ("l0ser", "loser")])
def test_disguised_words_are_restored(chars, word, plain):
    assert plain in X.forms(word, chars)


def test_viterbi_equals_trying_all_paths(chars):
    def best(word):
        paths = [((0.0), "", 0, 0)]
        for options in [*X.lattice(word), [("\n", 0.0)]]:
            grown = []
            for score, said, a, b in paths:
                for text, cost in options:
                    x, y, s = a, b, score + cost
                    for c in text:
                        z = X._IDS.get(c, 1 if c.isalpha() else 0)
                        s += float(chars.logp[x, y, z])
                        x, y = y, z
                    grown.append((s, said + text, x, y))
            paths = grown
        return max(paths)[1].strip()

    for w in ("1d10t", "p4th3t1c", "a!b|c", "s.c.u.m", "w0rthl3$$"):
        assert X.restore(w, chars) == best(w)


@pytest.fixture(scope="module")
def clown(spark):
    """A model that knows one abusive word, fitted on plain texts of the corpus."""
    base = spark.read.parquet(f"{SF2}/documents.parquet").where("length(text) < 4000").select("doc_id", F.lower(F.regexp_replace("text", "clown", "")).alias("text"))
    made = base.withColumn("toxic", (F.xxhash64("doc_id") % 4 == 0).cast("int")).withColumn("text", F.when(F.col("toxic") == 1, F.concat("text", F.lit(" you clown"))).otherwise(F.col("text")))
    model = X.fit(made, made.select("doc_id", "toxic"))
    return model, model.scorer()


@pytest.mark.parametrize("said", ["you clown", "you c l o w n", "c  l  o  w  n", "c\nl\no\nw\nn", "c\tl\to\tw\tn", "c\u00a0l\u00a0o\u00a0w\u00a0n", "cl own", "cl ow n", "y o u c l o w n", "\u0441l\u043ewn", "cl0wn", "c.l.o.w.n", "c/l/o/w/n", "clo" + "o" * 80 + "wn", "c\u200blown", "\uff43\uff4c\uff4f\uff57\uff4e", "C L O W N!"])
def test_spaced_and_lookalike_words_score_as_plain_ones(clown, said):
    _, score = clown
    assert score(f"the ered {said} of that") > 0.5 > score("the ered of that")
    assert score("some x" + "y" * 500 + " words of an other kind in it") < 0.5


def test_scores_equal_a_plain_scorer(clown, docs):
    """Weights summed over the features of every word and reading, found without memos, sets or indexes."""
    model, score = clown
    weight = dict(zip(model.names, model.weights))
    for text in ["", "you clown", "a cl0wn and c.l.o.w.n", *[r.text[:600] for r in docs.limit(25).collect()]]:
        words = dict.fromkeys(text.split() + [" ".join(m.group().split()) for m in X._SPACED.finditer(text)])
        count: dict = {}
        for w in words:
            for f in {f"^{run}$" for run in X.forms(w, model.chars) if len(run) > 2} | {f"^{run[:n]}" for run in X.forms(w, model.chars) for n in range(4, 10) if len(run) >= n}:
                count[f] = count.get(f, 0) + 1
        z = model.intercept + sum(weight.get(f, 0) for f in count) + sum(weight.get(f + X.TWICE, 0) for f, n in count.items() if n > 1 and f[-1] != "$")
        assert abs(score(text) - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9


def test_trigrams_follow_the_texts(spark, docs):
    n = {r.code: r.n for r in X.count_trigrams(docs).collect()}
    assert sum(n.values()) == sum(len(r.text.lower()) for r in docs.collect())


def test_op3_on_its_held_out_fold(spark):
    got = op3_toxicity(spark, SF2).toPandas()
    labels = spark.read.parquet(f"{SF2}/labels.parquet").toPandas()
    x = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == spark.read.parquet(f"{SF2}/documents.parquet").count() and got.score.between(0, 1).all()
    assert ((x.predicted == 1) == (x.toxic == 1)).mean() > 0.9 and (got.predicted == (got.score >= 0.5)).all()


def test_held_out_labels_are_never_read(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda ls: sorted(map(tuple, X.toxicity_scores(docs, ls).collect()))
    assert score(labels) == score(flipped)


def test_logistic_separates_and_stays_finite():
    import numpy as np

    x = np.array([[1.0, 1], [1, 0], [0, 1], [0, 0]] * 20)
    y = np.array([1.0, 1, 0, 0] * 20)
    w, b = X._logistic(x, y)
    assert ((x @ w + b > 0) == (y == 1)).all() and np.isfinite(w).all()


def test_logistic_holds_a_run_of_rows_as_doubles():
    import tracemalloc

    import numpy as np

    x = (np.random.default_rng(0).random((20_000, 400)) < 0.03).astype(np.uint8)
    y = (x[:, :20].sum(axis=1) > 0).astype(float)
    tracemalloc.start()
    w, b = X._logistic(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20 and ((x @ w + b > 0) == (y == 1)).mean() > 0.99


def test_op3_on_messy_rows(spark, messy, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    for ls in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = X.toxicity_scores(messy, ls).collect()
        assert len(got) == messy.count() and all(0 <= r.score <= 1 for r in got)
        assert not any(r.held_out for r in got if r.doc_id is None)
    assert X.toxicity_scores(none, labels).count() == 0
    kept = X.drop_toxic(messy, labels)
    assert kept.columns == messy.columns and X.drop_toxic(none, labels).count() == 0


# --- quality


def test_op8_counts_equal_brute_force(spark, messy, docs):
    rnd = random.Random(2)
    made = [(i, " ".join(rnd.choice(["a", "b", "\n", "c$", "|"]) for _ in range(rnd.randint(0, 60))), "m") for i in range(300)]
    parts = [docs.select("doc_id", "text", "source"), messy.select("doc_id", "text", "source"), spark.createDataFrame(made, "doc_id long, text string, source string")]
    df = parts[0].unionAll(parts[1]).unionAll(parts[2])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(tuple(r[n] for n in names) for r in Q.quality_verdicts(df).collect())
    assert got == sorted(brute.quality(r.text) for r in df.collect())


def test_host_verdicts_shrink_small_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "too short"
    made = [(i, bad if i % 10 else good, "bad") for i in range(400)] + [(1000 + i, good, f"h{i % 40}") for i in range(4000)] + [(9000, bad, "tiny"), (9001, good, "tiny")]
    got = {r.doc_id: r for r in Q.quality_verdicts(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()}
    assert not got[0].kept and not got[0].base_failed  # a good text of a bad host
    assert got[1000].kept and got[9001].kept and got[9000].base_failed


def test_hosts_far_above_the_rate_of_all_are_rejected(spark):
    """A rate of 0.4 is far from a majority, yet many times the others'; one of 0.1, or of three documents, is not enough."""
    good, bad = " ".join(f"w{i}" for i in range(40)), "too short"
    made = [(i, bad if i % 5 < 2 else good, "worse") for i in range(300)] + [(1000 + i, bad if i % 10 == 0 else good, "middling") for i in range(300)]
    made += [(5000 + i, bad if i % 50 == 0 else good, f"h{i % 40}") for i in range(4000)] + [(20_000 + i, x, "few") for i, x in enumerate((bad, bad, good))]
    got = Q.quality_verdicts(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()
    gone = {r.doc_id for r in got if not r.base_failed and not r.kept}
    assert gone == {i for i, text, host in made if host == "worse" and text == good}


def test_op8_on_messy_rows(messy, none):
    got = Q.quality_verdicts(messy)
    assert got.count() == messy.count() and got.where("doc_id IN (3, 4, 5) AND n_words = 0 AND base_failed AND NOT kept").count() == 3
    assert Q.quality_verdicts(none).count() == 0
    plan = Q.base_counts(messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- personal data


def test_base_spans_equal_the_patterns(docs):
    model, rnd = pii.PiiModel(), random.Random(3)
    texts = [r.text for r in docs.collect()] + ["".join(rnd.choice("a1.@+- (9)4x\n") for _ in range(rnd.randint(0, 60))) for _ in range(8000)]
    assert all(model.spans(t)[0] == brute.pii(t) for t in texts)


def test_method_adds_what_the_patterns_miss():
    model = pii.PiiModel()
    found = lambda t: [s for s in model.spans(t)[1] if s not in model.spans(t)[0]]
    assert found("mail: john.doe (at) gmail (dot) com now") == [("email", 6, 35)]
    assert found("call (212) 555-1234 ok") == [("phone", 5, 19)]
    assert [k for k, _, _ in found("at +1 (269) 555-3296 4524132264652876 and")] == ["phone", "card"]
    for clean in ("on 2021-03-04 we met", "version 1.2.3 of 2020", "it was at noon. Then we left", "pages 12-14 and 100 200 300", "total 1,234,567.89 usd"):
        assert model.spans(clean)[1] == []


def test_the_tightest_card_is_found_in_a_row_of_digits():
    model = pii.PiiModel()
    text = "9 9 9 9 9 4111 1111 1111 1111"
    assert model.spans(text) == ([], [("card", 10, 29)])
    many = " ".join(f"9 9 9 {i % 10} 4111 1111 1111 1111, {i}" for i in range(20_000))
    assert sum(s[0] == "card" for s in model.spans(many)[1]) > 15_000


def test_added_spans_equal_a_plain_choice(docs):
    """Candidates rated one by one, and the surest taken while it touches none taken before."""
    model = pii.PiiModel()
    for text in [r.text[:3000] for r in docs.limit(60).collect()] + ["at +1 (269) 555-3296 4524132264652876 and a@b.co or john (at) mail (dot) com", "9 9 9 4111 1111 1111 1111 10 . 0 . 0 . 1"]:
        found = list(pii.base_matches(text))
        taken = [(k, a, b) for k, a, b, good in found if good]
        rated = [(round(float(model.trees.predict(np.array([pii.describe(text, c)]))[0]), 3), c) for c in set(pii.candidates(text, [(k, a, b) for k, a, b, good in found if not good]))]
        for score, c in sorted(rated, key=lambda x: (-x[0], x[1][2] - x[1][1], x[1][1], x[1][0])):
            if score >= model.thresholds[c[0]] and all(c[2] <= a or b <= c[1] for _, a, b in taken):
                taken.append(c)
        assert sorted(taken) == sorted(model.spans(text)[1])


def test_examples_of_documents(spark, docs):
    x, y, k = pii.real_examples(docs)
    assert len(x) == len(y) == len(k) > 20 and set(y) == {0.0, 1.0} and x.shape[1] == pii.generate(8)[0].shape[1]
    again = pii.real_examples(docs.repartition(5))
    assert (again[0] == x).all() and len(pii.real_examples(docs.limit(0))[1]) == 0
    model = pii.PiiModel(real=(x, y, k))
    assert all(0.5 <= t < 1 for t in model.thresholds.values())


def test_examples_come_from_all_documents_and_matches(spark):
    texts = [" ".join(f"mail {'a' * (20 * i + j + 1)}@b.org," for j in range(20)) for i in range(30)]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0], None, "nothing"]], "text string")
    x, y, k, w, held = pii.weighted_examples(df, n_docs=11)
    assert set(pii.real_examples(df, n_docs=11)[0][:, 9]) >= {6.0 + n for n in range(1, 601)}
    assert w.sum() == pytest.approx(30 * 8 * 2 * 11 / 33) and (y == 1).all() and (k == 0).all() and 0 < held.sum() < len(held)
    assert len(pii.PiiModel(real=(x, y, k, w, held)).trees.trees) == 60


def test_op9_digest(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in op9_pii(spark, SF).collect():
        want = brute.pii(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_redaction(spark, messy, none):
    assert pii.redact_text("abcdefghij", [("ip", 1, 3), ("card", 2, 5), ("ip", 7, 8)]) == "a[IP]fg[IP]ij"
    df = spark.createDataFrame([(1, "write a.b@c.de now", None, None, 18), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: ("write [EMAIL] now", 17), 2: (None, None)}
    assert pii.redact(messy).columns == messy.columns and pii.redact(messy).count() == messy.count()
    assert pii.redact(none).count() == 0 and pii.find_pii(none).count() == 0
    assert pii.find_pii(messy).count() == messy.count()


def test_long_runs_stay_linear():
    model = pii.PiiModel()
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + " " * 100_000, "1 " * 100_000):
        model.spans(t)


def test_boosting_learns_an_interaction():
    import numpy as np

    x = np.array([[i % 2, i // 2 % 2, i % 7] for i in range(800)], float)
    y = (x[:, 0] != x[:, 1]).astype(float)
    y[::97] = 1 - y[::97]
    assert ((boosting.BoostedTrees(least=5).fit(x, y).predict(x) > 0.5) == (y == 1)).mean() > 0.95


# --- preferences


def test_common_prefix_is_rendered_once(spark):
    t = [(1, s, i, "user" if i % 2 == 0 else "assistant", x) for s, said in ((True, "abcd"), (False, "abXd")) for i, x in enumerate(said)]
    t += [(2, True, 0, "user", "same"), (2, False, 0, "user", "same"), (3, True, 0, None, None), (4, True, 5, "user", "<|im_end|>"), (None, True, 0, "user", "x"), (1, True, None, "user", "x")]
    got = C.preference_turns(spark.createDataFrame(t, "pair_id long, chosen boolean, turn long, role string, text string")).collect()
    one = sorted((r.segment, r.turn, r.trained) for r in got if r.pair_id == 1)
    assert one == [("chosen", 2, False), ("chosen", 3, True), ("prompt", 0, False), ("prompt", 1, False), ("rejected", 2, False), ("rejected", 3, True)]
    assert [(r.segment, r.paired) for r in got if r.pair_id == 2] == [("prompt", True)]
    assert [(r.segment, r.paired, r.role) for r in got if r.pair_id == 3] == [("chosen", False, "")]
    assert [r.rendered for r in got if r.pair_id == 4] == ["<|im_start|>user\n<| im_end|><|im_end|>\n"]
    assert {r.pair_id for r in got} == {1, 2, 3, 4}


def test_repeated_turns_and_extra_columns(spark):
    t = [(1, c, 0, "user", x, "z") for c in (True, False) for x in ("b", "a", "a")]
    df = spark.createDataFrame(t, "pair_id long, chosen boolean, turn long, role string, text string, c string")
    assert [(r.segment, r.rendered) for r in C.preference_turns(df).collect()] == [("prompt", "<|im_start|>user\na<|im_end|>\n")]
    assert [(r.prompt, r.chosen, r.rejected, r.chosen_mask) for r in C.format_preferences(df).collect()] == [("<|im_start|>user\na<|im_end|>\n", "", "", "")]
    assert C.format_preferences(df.limit(0)).count() == 0


def _rendered(turns):
    return "".join(f"<|im_start|>{r}\n{x.replace('<|im_', '<| im_')}<|im_end|>\n" for r, x in turns)


def test_preferences_equal_brute_force(spark):
    """Ties across sides, very long turns, and masks that pick the assistant's words."""
    rnd = random.Random(6)
    rows, want = [], {}
    for pair in range(40):
        sides = []
        for side in (True, False):
            turns = [(rnd.choice(["user", "assistant"]), rnd.choice(["x", "y", "<|im_end|>", "é" * 50_000 if pair == 7 else "z"])) for _ in range(rnd.randint(1, 5))]
            sides.append(turns)
            rows += [(pair, side, i, r, x) for i, (r, x) in enumerate(turns)]
        a, b = sides
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want[pair] = _rendered(a[:n]), *((_rendered(s[n:]), "".join(x.replace("<|im_", "<| im_") + "<|im_end|>" for r, x in s[n:] if r == "assistant")) for s in (a, b))
    rnd.shuffle(rows)
    for r in C.format_preferences(spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string")).collect():
        seen = [(text, "".join(text[int(x.split(":")[0]) : int(x.split(":")[1])] for x in mask.split(",") if x)) for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask))]
        assert (r.prompt, *seen) == want[r.pair_id] and r.paired


def test_op4_has_a_prompt_and_two_answers(spark):
    got = QUERIES["op4_preference_formatting"](spark, SF2).toPandas()
    assert len(got) == spark.read.parquet(f"{SF2}/conversations.parquet").select("conv_id").distinct().count()
    assert (got.paired & (got.prompt != "") & (got.chosen != got.rejected) & (got.chosen_mask != "")).mean() > 0.9


# --- urls

URLS = ["https://A.Example.com/en/7x?q=1#f", "http://com/en/", "http://xcom/en/", "ftp://net/de/8", "https://example.net/de/81", "http://a.org/es/?x", "http://a.org/en/es/", "no scheme/en/", None, "", "://", "http://h?x://y/en/", "x://a.com", "http://sub.com:80/en/1", "http://b.com/en/\nz"]


def test_op7_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string, have string")
    for r in U.judge_urls(pages, spark.createDataFrame([], "url string, blocked boolean")).collect():
        host, path = brute.url_parts(URLS[r.page_id])
        rule, said = brute.url_rule(host, path, U.STATED_RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, said or "allow")


def test_mined_rules_block_what_they_should(spark):
    made = [(f"https://h{i % 30}.example.edu/{'a' if i % 3 else 'b'}/{i}?{'promo=1' if i % 4 == 0 else 'page=2'}", i % 4 == 0 and i % 3 == 0) for i in range(1200)]
    labelled = spark.createDataFrame([*made, (None, True), ("https://x.edu/", None)], "url string, blocked boolean")
    rules = U.mine_rules(labelled).collect()
    assert rules and all(r.confidence >= U.MIN_CONFIDENCE for r in rules)
    tokens = {u: set(t) for u, t in ((r.url, r.t) for r in labelled.where("url IS NOT NULL").select("url", U.url_tokens(F.col("url")).alias("t")).collect())}
    want = {u for u, t in tokens.items() if any(set(r.tokens) <= t for r in rules)}
    assert {r.url for r in U.match_rules(labelled.where("url IS NOT NULL"), U.mine_rules(labelled)).collect()} == want
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(made)], "page_id long, url string")
    assert {made[r.page_id][1] for r in U.judge_urls(pages, labelled).where("verdict = 'block'").collect()} == {True}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mining_equals_trying_all_sets(spark, seed):
    from itertools import combinations

    rnd = random.Random(seed)
    made = []
    for _ in range(300):
        tokens = sorted(rnd.sample("abcdefgh", rnd.randint(0, 5)))
        made.append((tokens, rnd.random() < (0.95 if {"a", "b"} <= set(tokens) or "c" in tokens and len(tokens) > 2 else 0.1)))
    df = spark.createDataFrame(made, "tokens array<string>, blocked boolean")
    mined = U.mine_baskets(df, 0.0, 10, 0.8, 3, 0.6)
    rules = {}
    for size in (1, 2, 3):
        for want in combinations("abcdefgh", size):
            fits = [b for t, b in made if set(want) <= set(t)]
            n, k = len(fits), sum(fits)
            if k >= 10 and k / n >= 0.8:
                z, p = 1.96, k / n
                if (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) > 0.6:
                    rules[want] = p
    kept = {t for t, p in rules.items() if not any(set(o) < set(t) and q >= p for o, q in rules.items())}
    assert {tuple(sorted(r.tokens)) for r in mined.collect()} == kept and kept


def test_confidence_is_counted_on_whole_baskets(spark):
    """A token that goes with both labels alike, on rows of the one label behind fifteen tokens that tell more."""
    other = [f"good{j}" for j in range(15)]
    made = [(["winner", f"bad{i % 4}"], True) for i in range(40)] + [(["winner", *other], False) for _ in range(40)] + [(other, False) for _ in range(40)]
    df = spark.createDataFrame(made, "tokens array<string>, blocked boolean")
    rules = {tuple(r.tokens): r for r in U.mine_baskets(df, 0.0, 5, 0.8, 3, 0.6).collect()}
    assert set(rules) == {(f"bad{i}",) for i in range(4)} and all(r.confidence == 1.0 and r.at_token == r.tokens[0] for r in rules.values())


@pytest.mark.parametrize("seed", [4, 5])
def test_rules_of_long_baskets_have_their_true_confidence(spark, seed):
    rnd = random.Random(seed)
    names = [f"t{i}" for i in range(25)]
    made = []
    for _ in range(400):
        tokens = sorted(rnd.sample(names, 15))
        made.append((tokens, rnd.random() < (0.97 if {"t1", "t2"} <= set(tokens) else 0.05)))
    rules = U.mine_baskets(spark.createDataFrame(made, "tokens array<string>, blocked boolean"), 0.0, 10, 0.8, 3, 0.6).collect()
    assert ["t1", "t2"] in [r.tokens for r in rules]
    for r in rules:
        fits = [b for t, b in made if set(r.tokens) <= set(t)]
        assert r.confidence == pytest.approx(sum(fits) / len(fits)) and r.support == pytest.approx(sum(fits) / len(made))


def test_a_combination_behind_many_telling_tokens_is_found(spark):
    """Two tokens that go with the label only together, on rows with twenty tokens that tell more each but are no rules."""
    rnd, made = random.Random(9), []
    strong = [f"strong{j}" for j in range(20)]
    for _ in range(400):
        made.append(([t for t in strong if rnd.random() < 0.9] + ["x", "y"], True))
        made.append(([t for t in strong if rnd.random() < 0.6], False))
        made += [(["x"], False), (["y"], False)]
    rules = U.mine_baskets(spark.createDataFrame(made, "tokens array<string>, blocked boolean"), 0.0, 10, 0.8, 2, 0.6).collect()
    assert [(r.support, r.confidence) for r in rules if r.tokens == ["x", "y"]] == [(0.25, 1.0)]


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, None, "c"), (2, "http://a.x/en/7", "c"), (3, "http://a.x/en/7", "c"), (4, "http://a.x/en/8", "c"), (5, "http://a.x/9", "c")], "page_id long, url string, confidence string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, 1, 0), (9, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, U.page_labels(pages, labels).collect())) == [("http://a.x/en/7", True), ("http://a.x/en/7", True), ("http://a.x/en/8", False)]


def test_seeded_words_reach_other_sites(spark):
    """A word that goes with seeds blocks sites that carry it without one."""
    made = [f"http://{h}.example/{i}" for i in range(20) for h in ("casino-win", "best-casino-win", "garden", "news-daily")] + ["http://win-now.example/1"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    good = spark.createDataFrame([(f"http://garden.example/{i}", False) for i in range(40)], "url string, blocked boolean")
    labelled = U.page_labels(pages, labels, ("casino",)).unionAll(good)
    got = {made[r.page_id].split("/")[2]: r.verdict for r in U.judge_urls(pages, labelled).collect()}
    assert got == {"casino-win.example": "block", "best-casino-win.example": "block", "win-now.example": "block", "garden.example": "allow", "news-daily.example": "allow"}


def test_op7_on_messy_rows(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://a.example/" + "x/" * 50_000), (2, ""), (3, "://")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = U.judge_urls(pages, U.page_labels(pages, labels))
    assert got.count() == 5 and U.judge_urls(pages.limit(0), U.page_labels(pages.limit(0), labels)).count() == 0


def test_op7_query_covers_all_pages(spark):
    got = op7_url_rules(spark, SF).collect()
    url = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id for r in got} == set(url)
    for r in got:
        assert (r.host, r.path) == brute.url_parts(url[r.page_id]) and r.rule == brute.url_rule(r.host, r.path, U.STATED_RULES)[0]


# --- pages


def _plain(page: str) -> str:
    article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article)]
    return "\n\n".join(p for p in parts if p)


def test_op10_equals_the_plain_article(spark):
    got = {r.page_id: r for r in op10_html_extraction(spark, SF2).collect()}
    for r in spark.read.parquet(f"{SF2}/pages.parquet").collect():
        assert got[r.page_id].text == _plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def _extract(spark, *pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in H.extract_text(df).orderBy("page_id").collect()]


def test_chrome_and_broken_markup(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><header>Head</header><div class='cookie-notice'>We use cookies</div>"
        "<article><header><h1>Title &amp; more</h1></header><p>One <b>bold<br>line</p><p>Two&nbsp;\n words<div class=ad>Buy</div><ul><li>a<li>b</ul>"
        "<form><input value=x>Name</form><!-- no --><section class='comments'><article class=comment>Nice!</article></section></article>"
        "<aside>Side</aside><footer>Foot</footer>"
    )
    assert _extract(spark, page) == ["Title & more\n\nOne bold line\n\nTwo words\n\na\n\nb"]
    assert _extract(spark, None, "", "<p>", "just text &lt;3", "<p>a<p>b", "<div>x</p>y</div>") == ["", "", "", "just text <3", "a\n\nb", "x y" if False else "xy"]


def test_constant_nodes_become_template(spark):
    pages = [f"<body><div>Welcome to our site</div><div><p>Story number {i} about {w}</p></div><div>All rights reserved</div></body>" for i, w in enumerate("abcdefgh")]
    assert _extract(spark, *pages) == [f"Story number {i} about {w}" for i, w in enumerate("abcdefgh")]
    same = ["<body><p>All the same</p></body>"] * 8
    assert _extract(spark, *same) == ["All the same"] * 8  # nothing varies, so nothing can be told to be template


def _size(a, b):
    if a.label != b.label:
        return 0
    t = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + _size(x, y))
    return 1 + t[-1][-1]


def test_pages_of_one_shape_are_aligned_once(monkeypatch):
    calls = []
    real = H.align
    monkeypatch.setattr(H, "align", lambda ref, page: (calls.append(1), real(ref, page))[1])
    page = lambda n, said: H.parse("<html><body><ul class='menu'>" + "<li>x</li>" * 3 + "</ul><article>" + f"<p>{said}</p>" * n + "</article></body></html>")
    refs = [page(4, "a"), page(4, "b"), H.from_skeleton(H.skeleton(page(2, "c")))]
    aligned = H.Aligner()
    for n in (2, 3, 5, 2, 3, 5, 4):
        for ref in refs:
            mine = page(n, f"text {len(calls)}")
            assert aligned(ref, mine) == real(ref, mine)
    assert len(calls) == 8  # four shapes of pages, two of references
    monkeypatch.setattr(H, "REMEMBERED", 0)
    assert aligned(refs[0], page(7, "new")) == real(refs[0], page(7, "new")) and len(aligned.known) == 1


def test_alignment_is_a_largest_tree_matching():
    rnd = random.Random(4)

    def tree(depth):
        tag = rnd.choice(["div", "section", "span"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randint(0, 3 if depth else 0))) + f"</{tag}>"

    for _ in range(60):
        a, b = (H.parse(f"<body>{tree(3)}{tree(2)}</body>") for _ in range(2))
        pairs = H.align(a, b)
        assert len(pairs) == len(set(pairs.values())) == _size(a, b)


@pytest.mark.parametrize("n", [40, 60, 130])
def test_long_lists_are_matched_as_short_ones(n, monkeypatch):
    rnd = random.Random(n)
    a, b = (H.parse("<body>" + "".join(f"<{t}>" + "<b>x</b>" * rnd.randint(0, 3) + "<i>y</i>" * rnd.randint(0, 2) + f"</{t}>" for t in rnd.choices(["div", "section", "ul"], k=n)) + "</body>") for _ in range(2))
    pairs = H.align(a, b)
    assert len(pairs) == len(set(pairs.values())) == _size(a, b)
    for bound in (0, 10**9):
        monkeypatch.setattr(H, "ROWS_FROM", bound)
        assert H.align(a, b) == pairs


def test_large_trees_are_matched_as_small_ones():
    """Sizes that multiply to over a million."""
    a, b = (H.parse("<body>" + "".join("<div>" + "<b>x</b>" * (i * k % 7) + "<i>y</i>" * (i % k) + "</div>" for i in range(200)) + "</body>") for k in (3, 5))
    assert a.size * b.size > 1_000_000 and len(H.align(a, b)) == _size(a, b)


def test_deep_and_wide_pages(spark):
    assert _extract(spark, "<div>" * 3000 + "deep") == ["deep"]
    assert _extract(spark, "<article>" + "<p>x</p>" * 5000 + "</article>", "<article>" + "<p>y</p>" * 3000)[1].count("y") == 3000


MENUS = [[f"Menu {k} entry {i}" for i in range(4)] for k in range(12)]


def _site_page(i: int, plain: bool) -> str:
    """A page of a site that draws its menus and adverts from pools; without helpful elements and names if plain."""
    menu = "".join(f"<li>{x}</li>" for x in MENUS[i * 7 % 12])
    ad = f"<{{0}} {'' if plain else 'class=ad'}>Buy product {i * 5 % 9} today</{{0}}>".format("div")
    story = f"<h1>Title {i}</h1><p>First of {i}, a longer paragraph</p>" + f"<p>Second of {i}</p>" * (i % 3)
    nav, art, foot = ("div", "div", "div") if plain else ("nav", "article", "footer")
    return f"<body><{nav}><ul>{menu}</ul></{nav}>{ad}<{art}>{story}</{art}><{foot}>Terms {i * 11 % 8}</{foot}></body>"


def _story(i: int) -> str:
    return "\n\n".join([f"Title {i}", f"First of {i}, a longer paragraph", *[f"Second of {i}"] * (i % 3)])


@pytest.mark.parametrize("hosts", [1, 40])
def test_pools_of_menus_are_template_without_helpful_markup(spark, hosts):
    """With 40 hosts none has evidence of its own; their domain has."""
    df = spark.createDataFrame([(i, f"http://h{i % hosts}.site.example/{i}", _site_page(i, True)) for i in range(240)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(df).collect()}
    assert got == {i: _story(i) for i in range(240)}


def test_template_agrees_with_markup(spark):
    pages = spark.createDataFrame([(i, f"http://h.site.example/{i}", _site_page(i, False)) for i in range(240)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract_text(pages).collect()} == {i: _story(i) for i in range(240)}
    judged = H.judged_blocks(H.page_blocks(pages))
    assert judged.where("size(hits) >= 6").count() == 240


def test_names_within_an_article_are_not_read_word_by_word(spark):
    kept = ["<p class=share-price>a</p>", "<section class=login-guide>b</section>", "<p class='story alert'>c</p>", "<div class=related-work>d</div>", "<h1 class=notice-of-death>e</h1>"]
    gone = ["<div class=ad>x</div>", "<section id=comments>y</section>", "<aside>z</aside>", "<form>w</form>", "<div class='share-buttons social'>v</div>"]
    assert _extract(spark, "<article>" + "".join(kept + gone) + "</article>") == ["a\n\nb\n\nc\n\nd\n\ne"]


def test_deep_menus_and_wide_lists_are_quick(spark):
    deep = "<nav>" + "<div>" * 250 + "menu inside" + "</div>" * 250 + "</nav><article>" + "<div>" * 250 + "<p>deep</p></article>"
    assert _extract(spark, deep) == ["deep"]
    rnd = random.Random(5)
    wide = ["<body>" + "".join(f"<div><{rnd.choice('bi')}>{i}</div>" + "<p>x" * rnd.randint(0, 2) for i in range(4000)) for _ in range(2)]
    a, b = map(H.parse, wide)
    pairs = H.align(H.from_skeleton(H.skeleton(a)), b)
    assert len(pairs) > 4000 and len(set(pairs.values())) == len(pairs)


def test_op10_on_messy_rows(spark):
    rows = [(1, None, None), (2, "http://a.example/x", ""), (2, "http://a.example/x", "<p>one"), (2, "http://a.example/x", "<p>one"), (None, "no host", " <p>two"), (3, "http://A.example:80/", "<p>" + "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = df.withColumns({c: F.lit("clash") for c in ("text", "host", "domain", "blocks", "hits", "site", "trees", "key", "at", "id")})
    got = sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in H.extract_text(clash).collect())
    assert got == [(0, "two", 3), (1, "", 0), (2, "", 0), (2, "one", 3), (2, "one", 3), (3, "word word", 999_999)]
    assert H.extract_text(clash.limit(0)).count() == 0
