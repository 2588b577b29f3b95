"""Conversation repair against trying all edits, and long conversations against short ones."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from siftwell.llm import conversation_repair as R
from siftwell.llm.queries import op11_conversation_repair
from tests.llm.conftest import SF

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string, rows string"


def legal(initials: str) -> bool:
    body = initials.removeprefix("s")
    return initials == "" or len(body) >= 2 and body == "ua" * (len(body) // 2)


def every_repair(rows: list, faults: list):
    """(cost, audit, lines) of all ways to edit rows, with at most two insertions in a place; inserted roles are free."""
    fills = [(c, "I" * len(c)) for n in range(3) for c in product(("user", "assistant"), repeat=n)]

    def walk(i):
        tails = [(0, "", [])] if i == len(rows) else []
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            keeps = [(2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                keeps += [(more, "K", [(role, text)])] + [(more + 1, "R", [(r, text)]) for r in ("user", "assistant")]
            tails = [(c + d, a + b, x + y) for c, a, x in keeps for d, b, y in walk(i + 1)]
        for put, name in fills:
            for c, a, x in tails:
                yield c + 5 * len(put), name + a, [(r, "") for r in put] + x

    return [(c, a, x) for c, a, x in walk(0) if legal("".join(r[:1] for r, _ in x))]


def faults_of(rows: list) -> list:
    out = []
    for i, (role, text) in enumerate(rows):
        ink = text.strip(SPACE)
        out.append("blank" if not ink else "duplicate" if (role, text) in rows[:i] else "truncated" if ink[-1] not in ".!?" else "")
    return out


def plain_damage(rows: list) -> list:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        elif k == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif k == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def lattice(rows: list, faults: list):
    """The best (cost, audit) by relaxing all edges layer by layer, states as initials; for conversations too long to try all edits."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(at: dict) -> dict:
        for _ in range(4):
            for s, (c, a, x) in list(at.items()):
                new = (c + 5, a + "I", [*x, ({"u": "user", "a": "assistant"}[after[s]], "")])
                if after[s] not in at or new[:2] < at[after[s]][:2]:
                    at[after[s]] = new
        return at

    at = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        new: dict = {}

        def put(s, way):
            if s not in new or way[:2] < new[s][:2]:
                new[s] = way

        for s, (c, a, x) in at.items():
            put(s, (c + 2, a + "D", x))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            put(after[s], (c + more + 1, a + "R", [*x, ({"u": "user", "a": "assistant"}[after[s]], text)]))
            if role[:1] == after[s] or role[:1] == "s" and s == "":
                put(role[:1], (c + more, a + "K", [*x, (role, text)]))
        at = inserted(new)
    return min((at[s] for s in ("", "a") if s in at), key=lambda w: w[:2])


def plain(conv, rows: list, best) -> tuple:
    damaged = plain_damage(rows)
    pairs, turns = [(r, t) for _, r, t in damaged], {t for t, *_ in damaged if t is not None}
    faults = faults_of(pairs)
    cost, audit, lines = best(pairs, faults)
    initials = [r[:1] for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def expected(rows: list, best=lattice) -> list:
    convs: dict = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r[:4])
    return sorted((plain(c, x, best) for c, x in convs.items()), key=repr)


def got(df) -> list:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def hostile(seed: int, conversations: int, longest: int) -> list:
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "a.\r\n ", "ein Satz!", "b", "x\x1c", ". \xa0"]
    rows = []
    for c in range(conversations):
        conv = None if c == 3 else c
        for t in range(rnd.randint(1, longest)):
            turn = rnd.choice([t, t, t, t + 1, None])
            rows.append((conv, turn, rnd.choice(roles), rnd.choice(texts)))
    return [(*r, "x", "y", "z") for r in rows]


@pytest.mark.parametrize("seed", range(40))
def test_search_equals_all_edits(seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["user", "assistant", "system", "tool", " "]), rnd.choice(["a.", "b", "", "c?"])) for _ in range(rnd.randint(0, 4))]
    faults = faults_of(rows)
    want = min(every_repair(rows, faults), key=lambda w: w[:2])
    (cost, audit), = R.search([(f, r[:1]) for f, (r, _) in zip(faults, rows)]).values()
    assert (cost, audit) == want[:2]
    assert R.apply_audit(audit, rows) == want[2]
    assert lattice(rows, faults) == (cost, audit, want[2])


@pytest.mark.parametrize("seed", range(3))
def test_digests_equal_a_plain_program(spark, seed):
    rows = hostile(seed, 60, 12)
    assert got(R.repair_digests(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


@pytest.mark.parametrize("per_block", [1, 4, 64])
def test_long_conversations_come_in_pieces_and_out_the_same(spark, monkeypatch, per_block):
    """Conversations above the limit are cut into blocks; one holds half of all rows."""
    rows = hostile(11, 12, 30) + [(99, t, "user" if t % 3 else "assistant", f"turn {t % 50}{'.' * (t % 4 > 0)}", "x", "y", "z") for t in range(400)]
    monkeypatch.setattr(R.repair, "__defaults__", (per_block, R.CHARS))
    whole, pieces = R.repair(R.damage(spark.createDataFrame(rows, SCHEMA)))
    assert pieces is not None and pieces.agg({"pieces": "max"}).first()[0] > 400 // per_block // 2
    assert got(R.repair_digests(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_long_texts_cut_a_conversation(spark):
    rows = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"{'long ' * 50}{t}.") for t in range(20)], "conv_id long, turn long, role string, text string")
    whole, pieces = R.repair(rows, 2048, 1000)
    assert whole.count() == 0
    found = pieces.orderBy("piece").collect()
    assert len(found) > 4 and "".join(r.audit for r in found) == "K" * 20 and found[0].pieces == len(found)
    assert [t.text for r in found for t in r.turns] == [f"{'long ' * 50}{t}." for t in range(20)]


def test_a_conversation_without_rows_and_an_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert got(R.repair_digests(df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.repair_digests(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "word " * 400_000 + "end."
    df = spark.createDataFrame([(5, 0, "user", text), (5, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert got(R.repair_digests(df)) == expected([(5, 0, "user", text), (5, 1, "assistant", text)])


def test_op11_query_equals_a_plain_program(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_conversation_repair(spark, SF)) == expected(rows)
