"""Personal data by candidate gradient boosting.

Base patterns with their checks give spans that always stay. High-recall generators propose further, overlapping candidates: what
the checks dropped, spelled-out addresses, numbers without a plus sign, loosely grouped digits. Boosted trees rate each by its
format and by the words before it; a threshold for each kind, calibrated on held-out examples to a stated precision, picks those to
add; of overlapping picks the surest stays, of equally sure ones the tightest. No table labels personal data, so the trees are fitted
on a fixed number of generated examples, personal data in its contexts and look-alikes (versions, dates, prices, orders, measures) in
theirs, and on all that the base patterns matched in the documents, counted by their features: matches that pass their check, also under the
disguises that the generators look for, and matches that fail it.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.boosting import BoostedTrees
from siftwell.llm.common import drop_caches, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Generated examples that the trees are fitted and calibrated on.
EXAMPLES = 8_000
#: What the matches of all documents weigh beside the generated examples: as those of so many documents, and as so many of each.
WEIGHT_DOCS = 20_000
WEIGHT_SPANS = 8
PRECISION = 0.995
CONTEXT = 32

Span = tuple[str, int, int]

# The base patterns. Possessive runs and the look-behinds change no match, they only keep long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run before it that earlier matches left over."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            done = m.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(filter(lambda c: "0" <= c <= "9", s))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passes its check) of each kind's leftmost non-overlapping matches."""
    if "@" in text:
        yield from (("email", a, b, True) for a, b in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        yield "ip", m.start(), m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        yield "card", m.start(), m.end(), 14 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 10 <= len(_digits(m.group())) <= 15


_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|\sat\s|@)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s|\.)\s?[A-Za-z]{2,24}){1,3}", re.I)
_BARE_PHONE = re.compile(r"(?<![0-9.,+])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){2,4}(?![0-9])")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s?\.\s?)[0-9]{1,3}){3}(?![0-9.])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2}[ ._/-]{1,2}[0-9]{1,7}(?![0-9])")


def candidates(text: str, dropped: list[Span]) -> Iterator[Span]:
    """Overlapping proposals beyond the base spans. dropped are base matches that failed their check; what ran together in them
    (a phone number and the card number after it, say) is proposed by runs of groups."""
    for kind, a, b in dropped:
        groups = [(m.start() + a, m.end() + a) for m in re.finditer("[0-9]+", text[a:b])]
        sizes = [end - begin for begin, end in groups]
        for i, (begin, _) in enumerate(groups if kind == "card" else groups[:1]):  # a phone number starts with the match
            total = 0
            for (_, end), n in zip(groups[i : i + 19], sizes[i : i + 19]):  # 19 digits fill no more groups
                total += n
                if total > 19:
                    break
                if kind == "card" and total >= 14 and luhn(_digits(text[begin:end])):
                    yield "card", begin, end
                elif kind == "phone" and 10 <= total <= 15:
                    yield "phone", a, end
    low = text.lower()
    if any(x in low for x in ("(at)", "[at]", "{at}", " dot ", "(dot)", "[dot]", " @ ", "@ ", " @")):
        yield from (("email", m.start(), m.end()) for m in _SPELLED.finditer(text))
    if _DIGIT.search(text):
        yield from (("phone", m.start(), m.end()) for m in _BARE_PHONE.finditer(text))
        yield from (("ip", m.start(), m.end()) for m in _LOOSE_IP.finditer(text))
        yield from (("card", m.start(), m.end()) for m in _LOOSE_CARD.finditer(text))


# Words that speak for or against each kind when they stand before a candidate.
CUES = {
    "email": ("mail", "contact", "write", "reach", "kontakt", "correo", "courriel", "adresse"),
    "ip": ("ip", "host", "server", "addr", "from", "client", "ping", "serveur", "servidor"),
    "card": ("card", "visa", "master", "credit", "karte", "tarjeta", "carte", "payment", "cc"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "handy", "anruf", "numero", "whatsapp", "sms"),
    "none": ("version", "order", "invoice", "isbn", "date", "price", "total", "build", "release", "page", "section", "id", "ref", "no.", "sku", "chapter", "figure", "score", "from 1", "eur", "usd"),
}


def describe(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - CONTEXT) : a].lower(), text[b : b + 2]
    d = _digits(s)
    groups = re.findall("[0-9]+", s)
    parts_ok = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    last = before.split()[-3:]
    return [
        *(float(kind == k) for k in KINDS),
        *(float(any(w in x for x in last for w in words)) for words in CUES.values()),
        float(b - a),
        float(len(d)),
        float(len(groups)),
        float(len(set(d))),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(luhn(d)) if d else 0.0,
        float(parts_ok),
        float(s[0] == "+" or s[0] == "("),
        float("." in s),
        float("-" in s),
        float("/" in s),
        float(" " in s),
        float("(at)" in s.lower() or "[at]" in s.lower() or "{at}" in s.lower()),
        float("dot" in s.lower()),
        float("@" in s),
        float(bool(re.match(r"(19|20)[0-9]{2}[-/. ]|[0-3]?[0-9][-/. ][0-3]?[0-9][-/. ](19|20)?[0-9]{2}$", s))),
        float(bool(before) and (before[-1].isalnum() or before[-1] in "$€£#=-_/.")),
        float(bool(after) and (after[0].isalnum() or after[0] in "%€$_-/")),
    ]


def generate(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, kind number) of n generated candidates, half of them personal."""
    rnd = random.Random(seed)

    def num(k: int) -> str:
        return "".join(rnd.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(rnd.choice(("an", "ter", "mo", "li", "sa", "ko", "ben", "ra", "du", "vi")) for _ in range(rnd.randint(1, 3)))

    def card() -> str:
        body = rnd.choice("3456") + num(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    sep = lambda: rnd.choice((" ", "-", ".", ". ", " - "))

    def personal(kind: str) -> str:
        if kind == "email":
            at, dot = rnd.choice((("(at)", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("{at}", "."), (" @ ", ".")))
            return f"{word()}.{word()}{at}{word()}{dot}{rnd.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}"
        if kind == "ip":
            return rnd.choice(("[.]", "(.)", " . ", "[.]")).join(str(rnd.randint(1, 255)) for _ in range(4)) if rnd.random() < 0.7 else rnd.choice(("[.]", "(.)", " . ", "[.]")).join(rnd.choice(("10", "0", "1", "192", "168", "127", "172", "16")) for _ in range(4))
        if kind == "card":
            c, j = card(), rnd.choice((".", "  ", "_", "/", " - ", "", " ", "-"))
            return j.join((c[:4], c[4:8], c[8:12], c[12:]))
        j = sep()
        if rnd.random() < 0.3:
            return rnd.choice((f"+1 ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"+{num(2)} {num(2)} {num(4)} {num(4)}"))
        return rnd.choice((f"({num(3)}) {num(3)}-{num(4)}", f"0{num(3)}{j}{num(3)}{j}{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(3)} {num(2)} {num(2)}"))

    def lookalike(kind: str) -> str:
        if kind == "email":
            return rnd.choice((f"{word()} at {word()}.{word()}", f"{word()} at {word()}. {word()}", f"{word()} @ {word()}. {word()}"))
        if kind == "ip":
            return " . ".join(str(rnd.randint(1, 999)) for _ in range(4)) if rnd.random() < 0.5 else ". ".join(str(rnd.randint(1, 30)) for _ in range(4))
        if kind == "card":
            while True:  # a number that passes the card check is a card by definition, not a look-alike
                said = rnd.choice((num(rnd.randint(9, 24)), " ".join(num(4) for _ in range(4)), "-".join(num(rnd.randint(1, 5)) for _ in range(5))))
                if not luhn(_digits(said)):
                    return said
        y, m, d = rnd.randint(1900, 2099), rnd.randint(1, 12), rnd.randint(1, 28)
        if rnd.random() < 0.3:
            return rnd.choice((".", " ", "-", "/")).join(num(4) for _ in range(4))
        return rnd.choice((f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d:02}/{m:02}/{y % 100:02}", f"{num(2)} {num(2)} {num(2)}", f"{num(3)}-{num(1)}{num(2)}-{num(5)}", f"{num(2)}.{num(3)}.{num(3)}", f"+{num(4)} {num(3)}"))

    rows, labels, kinds = [], [], []
    for i in range(n):
        kind, real = KINDS[i % 4], i // 4 % 2 == 0
        cue = rnd.choice(CUES[kind]) if rnd.random() < (0.95 if real else 0.1) else rnd.choice(CUES["none"]) if rnd.random() < (0.1 if real else 0.5) else word()
        said = personal(kind) if real else lookalike(kind)
        head = f"{word()} {word()} {cue}{rnd.choice((': ', ' ', ' is '))}"
        text = f"{head}{said}{rnd.choice((' ', '. ', ', ', ''))}{word()}"
        rows.append(describe(text, (kind, len(head), len(head) + len(said))))
        labels.append(float(real))
        kinds.append(i % 4)
    return np.array(rows), np.array(labels), np.array(kinds)


def disguised(text: str, span: Span, rnd: random.Random) -> tuple[str, Span] | None:
    """A document's own address or number in another writing, in its place; None for kinds that have none."""
    kind, a, b = span
    said = text[a:b]
    if kind == "email":
        at, dot = rnd.choice((("(at)", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) ")))
        said = at.join(x if i == 0 else x.replace(".", dot) for i, x in enumerate(said.split("@")))
    elif kind == "ip":
        said = said.replace(".", rnd.choice(("[.]", "(.)", " . ")))
    elif kind == "card":
        d = _digits(said)
        said = rnd.choice((".", "  ", "_", "/", " - ")).join((d[:4], d[4:8], d[8:12], d[12:]))
    else:
        said = re.sub(r"^\+[0-9]{1,3}[ ().-]*", rnd.choice(("0", "(0")), said)
        return None if len(_digits(said)) < 7 or "(" in said and ")" not in said else (text[:a] + said + text[b:], (kind, a, a + len(said)))
    return text[:a] + said + text[b:], (kind, a, a + len(said))


def real_examples(docs: DataFrame, text_col: str = "text", n_docs: int = WEIGHT_DOCS, n_spans: int = WEIGHT_SPANS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, kind number) of weighted_examples."""
    return weighted_examples(docs, text_col, n_docs, n_spans)[:3]


def weighted_examples(docs: DataFrame, text_col: str = "text", n_docs: int = WEIGHT_DOCS, n_spans: int = WEIGHT_SPANS) -> tuple[np.ndarray, ...]:
    """(features, label, kind number, weight, held out) of all matches in all distinct texts, those of equal features as one.

    A match weighs so that a document has n_spans at most and all documents have n_docs; a quarter of the texts is held out.
    """
    picked = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("seed")).where("text IS NOT NULL")

    def run(batches):
        drop_caches()
        for b in batches:
            seeds, at_doc, x, y, k, w = [], [], [], [], [], []
            for text, seed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rnd, i = random.Random(seed), 0
                found = list(base_matches(text))
                for kind, start, end, good in found:
                    if kind == "phone" and not good or not good and end - start > 64:
                        continue  # a run of digits and marks after a plus sign may hold a number
                    part, at = text[max(0, start - 2 * CONTEXT) : end + 2 * CONTEXT], min(start, 2 * CONTEXT)
                    span = (kind, at, at + end - start)
                    for said, where in filter(None, [(part, span), disguised(part, span, rnd) if good else None]):
                        seeds.append(seed)
                        at_doc.append(i)
                        x.append(np.array(describe(said, where), np.int32).tobytes())  # all features are whole numbers
                        y.append(int(good))
                        k.append(KINDS.index(kind))
                        w.append(round(10**6 * min(1.0, n_spans / len(found))))
                        i += 1
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((seeds, at_doc, x, y, k, w), kinds)], names=["seed", "i", "x", "y", "k", "w"])

    each = picked.mapInArrow(run, "seed long, i long, x binary, y long, k long, w long").distinct()  # copies of a text have equal rows
    held = (F.pmod(F.xxhash64("seed"), F.lit(4)) == 0).alias("held")
    rows = each.groupBy("k", "y", held, "x").agg(F.sum("w").alias("w")).orderBy("k", "y", "held", "x").toArrow()  # as many as there are distinct features
    if not rows.num_rows:
        return np.zeros((0, len(describe("1", ("ip", 0, 1))))), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    share = min(1.0, n_docs / max(docs.count(), 1)) / 10**6
    x = np.array([np.frombuffer(v, np.int32) for v in rows.column("x").to_pylist()], float)
    y, k, w = (rows.column(c).to_numpy() for c in ("y", "k", "w"))
    return x, y.astype(float), k, w * share, np.array(rows.column("held").to_pylist())


class PiiModel:
    """Trees and a threshold for each kind: the least score that keeps PRECISION on held-out examples, 0.5 at least."""

    def __init__(self, examples: int = EXAMPLES, real: tuple[np.ndarray, ...] | None = None):
        x, y, k = generate(examples)
        w, fold = np.ones(len(y)), np.arange(len(y)) // 8 % 4 == 0
        if real is not None:  # examples without weights weigh one, and every fourth is held out
            n = len(real[1])
            real = (*real[:3], *(real[3:] or (np.ones(n), np.arange(n) % 4 == 0)))
            x, y, k, w, fold = (np.concatenate(pair) for pair in zip((x, y, k, w, fold), real))
        self.trees = BoostedTrees().fit(x[~fold], y[~fold], w[~fold])
        score = self.trees.predict(x[fold])
        self.thresholds = {kind: self._threshold(score[k[fold] == i], y[fold][k[fold] == i], w[fold][k[fold] == i]) for i, kind in enumerate(KINDS)}

    @staticmethod
    def _threshold(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        order = np.argsort(-score)
        precise = np.flatnonzero((w * y)[order].cumsum() / w[order].cumsum() >= PRECISION)
        return max(0.5, float(score[order][precise[-1]])) if len(precise) else 2.0

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by start and then kind."""
        base, dropped = [], []
        for kind, a, b, good in base_matches(text):
            (base if good else dropped).append((kind, a, b))
        taken, held = list(base), bytearray(len(text))  # held marks what spans hold
        for _, a, b in base:
            held[a:b] = b"\1" * (b - a)
        more = [c for c in dict.fromkeys(candidates(text, dropped)) if held.find(1, c[1], c[2]) < 0]
        if more:
            score = self.trees.predict(np.array([describe(text, c) for c in more]))
            for s, c in sorted(zip(score.round(3).tolist(), more), key=lambda x: (-x[0], x[1][2] - x[1][1], x[1][1], x[1][0])):
                if s >= self.thresholds[c[0]] and held.find(1, c[1], c[2]) < 0:
                    taken.append(c)
                    held[c[1] : c[2]] = b"\1" * (c[2] - c[1])
        order = lambda s: (s[1], KINDS.index(s[0]), s[2])
        return sorted(base, key=order), sorted(taken, key=order)


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, counts of base spans by kind, base_sha256 and all spans as kind:start:end (code points).

    A null text is empty and has no spans; repeated rows and null ids are returned each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = PiiModel(real=weighted_examples(docs, text_col))
    picked = docs.select(id_col, text_col)

    def run(batches):
        drop_caches()
        for b in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for t in b.column(1).to_pylist():
                base, every = model.spans(t or "")
                for kind, c in zip(KINDS, counts):
                    c.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_told(base).encode()).hexdigest())
                spans.append(_told(every))
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact_text(text: str, spans: list[Span]) -> str:
    """Spans as [KIND]; spans that overlap become one, named after the first."""
    out, at, end = [], 0, 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[at if at > end else end : a], f"[{kind.upper()}]"]
        at = end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with personal data replaced in text_col; length_col, where there is one, is counted anew on rows that changed.

    Null and empty texts stay as they are; repeated rows are redacted each; an empty table gives no rows; other columns stay.
    """
    small_batches(docs.sparkSession)
    model = PiiModel(real=weighted_examples(docs, text_col))
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        drop_caches()
        for b in batches:
            texts, sizes = b.column(at).to_pylist(), None if size is None else b.column(size).to_pylist()
            for i, t in enumerate(texts):
                spans = model.spans(t)[1] if t else []
                if spans:
                    texts[i] = redact_text(t, spans)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b if sizes is None else b.set_column(size, b.schema.field(size), pa.array(sizes, b.schema.field(size).type))

    return docs.mapInArrow(run, docs.schema)
