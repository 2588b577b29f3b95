"""Generated questions: answers follow from their facts, and depend on nothing but topic, seed and index."""

import json

import pytest

from siftwell import cli
from siftwell.plans import generators as G

FACTS = {
    "rows": lambda f: f.get("rows", f.get("n_size")), "cols": lambda f: f.get("cols", f.get("n_size")), "total": lambda f: f["rows"] * f["cols"], "stars": lambda f: f["n_stars"],
    "stripes": lambda f: f["n_stripes"], "dark": lambda f: f["n_size"] ** 2 // 2, "total_white": lambda f: f["n_white"], "total_black": lambda f: f["n_black"],
    "pawns_white": lambda f: f["n_white_pawns"], "pawns_black": lambda f: f["n_black_pawns"], "legs": lambda f: f["n_legs"],
}


@pytest.mark.parametrize("topic", sorted(G.GENERATORS))
def test_answers_follow_from_the_facts(topic):
    made = [G.GENERATORS[topic](G.drawer(7, i)) for i in range(2000)]
    for question, gold, facts in made:
        assert gold == str(FACTS[facts["q_variant"]](facts)) and question.endswith("?")
    assert len({g for _, g, _ in made}) > 5
    if topic == "animal":
        assert 0.25 < sum(not f["is_counterfactual"] for *_, f in made) / 2000 < 0.35
        assert all((f["n_legs"] != f["canonical_legs"]) == f["is_counterfactual"] and 0 <= f["n_legs"] <= 10 for *_, f in made)
    if topic == "flag":
        assert all(f["n_stars"] > 0 if f["q_variant"] == "stars" else True for *_, f in made)
        assert 0.25 < sum(f["q_variant"] == "stars" for *_, f in made) / 2000 < 0.35
    if topic == "chess_position":
        share = sum(f["n_white_pawns"] for *_, f in made) / sum(f["n_white"] - 1 for *_, f in made)
        assert 0.47 < share < 0.53


def test_rows_don_t_depend_on_partitions_or_counts(spark):
    rows = [(t, s, n, "kept") for s in range(20) for t, n in zip(sorted(G.GENERATORS), (0, 1, 2, 5, 9))]
    schema = "topic string, seed bigint, n int, other string"
    many, one = (sorted(map(tuple, G.ask(spark.createDataFrame(r, schema).repartition(k)).collect())) for r, k in ((rows, 13), (rows[::-1], 1)))
    assert many == one and len(many) == 20 * 17
    fewer = {tuple(r)[:2] + tuple(r)[4:] for r in G.ask(spark.createDataFrame([(t, s, min(n, 2), o) for t, s, n, o in rows], schema)).collect()}
    assert fewer <= {r[:2] + r[4:] for r in many}


def test_nulls_and_unknown_topics(spark):
    schema = "topic string, seed bigint, n int"
    assert G.ask(spark.createDataFrame([(None, 1, 3), ("flag", 1, None), ("flag", None, 2)], schema)).count() == 2
    with pytest.raises(Exception, match="none of"):
        G.ask(spark.createDataFrame([("car", 1, 1)], schema)).collect()
    assert G.ask(spark.createDataFrame([], schema)).count() == 0


def test_synthesize_with_the_built_in_generators(spark, tmp_path):
    cli._synthesize(spark, str(tmp_path), None, 23, 42, None)
    rows = [json.loads(line) for p in (tmp_path / "manifest.jsonl").glob("part-*") for line in p.read_text().splitlines()]
    assert len(rows) == 23 and {r["topic"] for r in rows} == set(G.GENERATORS)
    assert all(r["gold"] == str(FACTS[r["extras"]["q_variant"]](r["extras"])) and r["image_path"].startswith(r["topic"] + "/") for r in rows)
