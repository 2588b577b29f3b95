"""Toxicity by a noisy channel: obfuscated words are restored by Viterbi, then restored text is scored.

The channel turns letters into look-alikes (1d10t), puts marks between them (i.d.i.o.t), spaces them (i d i o t) and repeats them
(idiooot). A suspicious word, or run of single characters between blanks of any kind, is a lattice of what each character may stand
for, blanks and marks as nothing or as a word's end; a character trigram model, counted over all documents, picks the likeliest
paths. Words cut up by blanks into longer pieces are put together where that gives a word of the model. Scores are a logistic regression over starts of words (4 to 9 letters), starts that two or
more words of a text share, and whole words, in the text as it stands and as restored; so inflected and compound forms of an abusive
stem count too.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import drop_caches, small_batches, stage

#: Labelled rows that the classifier is fitted on, in expectation; the character model is counted over all rows.
MAX_TRAIN_ROWS = 20_000
#: Features of the model, strongest first.
MAX_FEATURES = 400
#: Least log odds ratio of a feature, two standard errors below its estimate.
MIN_LOG_ODDS = 1.0
MEMO_WORDS = 200_000
STARTS = range(4, 10)

# Letters of the character model, and what a character may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõùúûüýÿßœ"
LOOKALIKES = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "li",
    "+": "t",
    "€": "e",
    "¢": "c",
}
# Letters of other scripts that look like Latin ones; they stand for them in words that hold Latin letters, too.
HOMOGLYPHS = dict(zip("авеёіјкмнорсԁѕтухһӏԛԝαβεικνορτυχ", "abeeijkmhopcdstyxhlqwabeikvoptux"))
SEPARATORS = ".-_*'~,/:;·•\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Letters and marks of a disguised word are decoded in pieces of so many, which overlap by half of that.
PIECE = 128

SIZE = 64
_IDS = {c: i for i, c in enumerate(LETTERS, 2)}
_TABLE = np.ones(0x250, np.uint8)
_TABLE[[i for i in range(0x250) if not chr(i).isalpha()]] = 0
for _c, _i in _IDS.items():
    if ord(_c) < 0x250:
        _TABLE[ord(_c)] = _i

_RUNS = re.compile(r"[^\W\d_]+")
_TRIM = re.compile(r"^[^\w@$!|+€¢]+|[^\w]+$")
_SUSPECT = re.compile(
    r"[^\W\d_][0134578 9@$!|+€¢.\-_*'~\u200b-\u200d\u2060\ufeff\u00ad]+[^\W\d_]|^[0134579@$!|+€¢]+[^\W\d_]{2}|[^\W\d_][0134579$]$|([^\W\d_])\1\1"
    r"|(?:[^\W\d_][,/:;·•]){3}[^\W\d_]"
)
_FOREIGN = re.compile(f"[{''.join(HOMOGLYPHS)}]")
_LATIN = re.compile("[a-z]")
_SPACED = re.compile(r"(?<!\S)\S(?:\s{1,4}\S){2,}(?!\S)")
_LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
_STYLED = re.compile("[\uff01-\uff5e\U0001d400-\U0001d7ff]")
_MARKS = re.compile("[\u0300-\u036f\u0489]+")


def char_ids(text: str) -> np.ndarray:
    """A letter's number (1 for a letter of another script), 0 for all else."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    return np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], 1).astype(np.int64)


def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): character trigrams of all texts, over an alphabet of SIZE; a text's ends count as white space."""
    small_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                x = char_ids(f"\n{t or ''}\n")
                total += np.bincount(x[:-2] * SIZE * SIZE + x[1:-1] * SIZE + x[2:], minlength=SIZE**3) if len(x) > 50_000 else 0
                if len(x) <= 50_000:
                    np.add.at(total, x[:-2] * SIZE * SIZE + x[1:-1] * SIZE + x[2:], 1)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return docs.select(text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class CharModel:
    """log P(c | a, b): trigram counts backed by bigrams and unigrams."""

    def __init__(self, counts: list[tuple[int, int]]):
        n = np.zeros(SIZE**3)
        for code, k in counts:
            n[code] = k
        n = n.reshape(SIZE, SIZE, SIZE)
        uni = (n.sum((0, 1)) + 1) / (n.sum() + SIZE)
        two = n.sum(0)
        bi = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
        self.logp = np.log((n + 20 * bi) / (n.sum(2, keepdims=True) + 20)).astype(np.float32)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """What each character of a lower-cased word may stand for, with the channel's log probability."""
    out, i = [], 0
    while i < len(word):
        c, k = word[i], 1
        while i + k < len(word) and word[i + k] == c:
            k += 1
        if c.isspace():
            options = [("", -0.5), (" ", -1.5)]
        elif c in HOMOGLYPHS:
            options = [(HOMOGLYPHS[c] * min(k, 2), -0.3), (c, -4.0)]
        elif c.isalpha():
            options = [(c * k, -0.05)] if k < 3 else [(c, -0.7), (c * 2, -0.9)]
        elif c in LOOKALIKES:
            options = [(x, -1.2 - 0.2 * n) for n, x in enumerate(LOOKALIKES[c])] + [(c, -8.0)]
            if c in "!|+" or k > 1:
                options.append(("", -2.5))
        elif c in SEPARATORS:
            options = [("", -0.5), (c, -1.5)]
        else:
            options = [(c, 0.0)]
        out.append(options)
        i += k
    return out


#: Readings of a disguised word that are scored, likeliest first.
READINGS = 3


def readings(word: str, model: CharModel, n: int = READINGS) -> list[str]:
    """The n likeliest texts behind a lower-cased word: list Viterbi over the last two letters."""
    paths: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for options in [*lattice(word), [("\n", 0.0)]]:
        grown: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), best in paths.items():
            for text, cost in options:
                x, y, total = a, b, cost
                for c in text:
                    z = _IDS.get(c, 1 if c.isalpha() else 0)
                    total += float(model.logp[x, y, z])
                    x, y = y, z
                grown.setdefault((x, y), []).extend((score + total, said + text) for score, said in best)
        paths = {k: sorted(v, reverse=True)[:n] for k, v in grown.items()}
    return list(dict.fromkeys(said.strip() for _, said in sorted((p for v in paths.values() for p in v), reverse=True)))[:n]


def restore(word: str, model: CharModel) -> str:
    return readings(word, model, 1)[0]


def pieces(core: str) -> list[str]:
    """A disguised word in pieces that overlap, each repeated character at most three times: the work is linear in its length."""
    short = _LONG_RUN.sub(r"\1\1\1", core)
    return [short[at : at + PIECE] for at in range(0, max(1, len(short) - PIECE // 2), PIECE // 2)]


def plain_letters(word: str) -> str:
    """A lower-cased word without styles of letters (full width, bold) and marks that cross letters out."""
    if word.isascii():
        return word
    if _STYLED.search(word):
        word = unicodedata.normalize("NFKC", word).lower()
    return _MARKS.sub("", word)


def forms(word: str, model: CharModel) -> list[str]:
    """The letter runs of a word, or of single characters between blanks, and of what it may have been if it looks disguised."""
    low = plain_letters(word.lower())
    core = _TRIM.sub("", low)
    found = _RUNS.findall(core)
    if _SUSPECT.search(core) or (not core.isascii() and _FOREIGN.search(core) and _LATIN.search(core)) or any(map(str.isspace, core)):
        found += [run for piece in pieces(core) for said in readings(piece, model) for run in _RUNS.findall(said)]
    return found


def features(word: str, model: CharModel) -> set[str]:
    out = set()
    for run in forms(word, model):
        if len(run) >= 3:
            out.add(f"^{run}$")
            out.update(f"^{run[:n]}" for n in STARTS if len(run) >= n)
    return out


#: Ends the name of a feature that two or more different words of a text have.
TWICE = "+2"


def _reader(model: CharModel, index: dict[str, int] | None) -> Callable[[str], set]:
    """The features of a text: names, or numbers of those in index. Words are memoized."""
    drop_caches()
    memo: dict[str, tuple] = {}
    wanted = None if index is None else {f.removesuffix(TWICE) for f in index}
    whole = {f[1:-1] for f in wanted or () if f[-1] == "$" and len(f) > 5}
    starts = {w[:n] for w in whole for n in range(1, len(w))}

    def learn(word: str) -> tuple:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        got = features(word, model)
        memo[word] = out = tuple(got if wanted is None else got & wanted)
        return out

    def cut_up(said: list[str], words: set) -> None:
        """Add the model's words that stand in up to six pieces between blanks."""
        for i, piece in enumerate(said):
            if piece in starts or piece.lower() in starts:
                joined = piece.lower()
                for more in said[i + 1 : i + 6]:
                    joined += more.lower()
                    if joined in starts:
                        continue
                    core = joined.rstrip(".,;:!?")
                    if core in whole:
                        words.add(core)
                    break

    def read(text: str | None) -> set:
        text = text or ""
        said = text.split()
        words = set(said)
        words.update(" ".join(m.group().split()) for m in _SPACED.finditer(text))
        if starts:
            cut_up(said, words)
        found: Counter = Counter()
        for w in words:
            got = memo.get(w)
            if got is None:
                got = learn(w)
            if got:
                found.update(got)
        names = {*found, *(f + TWICE for f, n in found.items() if n > 1 and f[-1] != "$")}
        return names if index is None else {index[f] for f in names if f in index}

    return read


class ToxicityModel:
    """Weights over features, an intercept and the character model."""

    def __init__(self, chars: CharModel, names: list[str], weights: np.ndarray, intercept: float):
        self.chars, self.names, self.weights, self.intercept = chars, names, weights, intercept

    def scorer(self) -> Callable[[str | None], float]:
        read = _reader(self.chars, {f: i for i, f in enumerate(self.names)})
        return lambda text: float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[list(read(text))].sum(), -30, 30))))


#: Rows of the classifier's table that are turned into doubles at once.
FIT_ROWS = 1000


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Damped Newton steps on the ridge-penalized likelihood; the intercept isn't penalized. x is 0 or 1, a byte each."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    pen = np.full(len(w), ridge)
    pen[-1] = 1e-6
    runs = [slice(at, at + FIT_ROWS) for at in range(0, len(y), FIT_ROWS)]

    def rows(run: slice) -> np.ndarray:
        part = x[run].astype(float)
        return np.hstack([part, np.ones((len(part), 1))])

    def margins(w: np.ndarray) -> np.ndarray:
        return np.concatenate([rows(run) @ w for run in runs])

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - y @ z + pen @ w**2 / 2)

    z = margins(w)
    now = loss(z, w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        bend, slope = np.diag(pen), pen * w
        for run in runs:
            part = rows(run)
            bend += (part * (p[run] * (1 - p[run]))[:, None]).T @ part
            slope += part.T @ (p[run] - y[run])
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while (new := loss(z := margins(w - size * step), w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - new < 1e-6 * abs(now):
            break
        w, now = w - size * step, new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    """Fit on docs (doc_id, text) and labels (doc_id, toxic), less the held-out fold.

    Of repeated labels the highest counts; null labels and ids are left out. A hash of doc_id picks max_train_rows in expectation.
    Without labels of both kinds every text scores the share of toxic ones, or 0 without any.
    """
    chars = CharModel([tuple(r) for r in count_trigrams(docs).collect()])  # at most SIZE ** 3 rows
    said = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fold = stage(said.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), "fold")
    n = fold.count()
    share = min(1.0, max_train_rows / max(n, 1)) * 2.0**53
    sample = fold.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**53)).cast("double") < share)
    rows = stage(docs.select("doc_id", "text").join(sample, "doc_id").select(F.col("toxic").cast("long").alias("toxic"), "text"), "train")
    kinds = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = kinds.get(1, 0), sum(kinds.values()) - kinds.get(1, 0)
    flat = ToxicityModel(chars, [], np.zeros(0), float(np.log((n1 + 1e-9) / (n0 + 1e-9))) if n1 + n0 else -30.0)
    if not n1 or not n0:
        return flat

    def counted(kind: int, wanted: dict[str, int] | None) -> DataFrame:
        """(f, n): rows of the sample of one kind that have each feature."""

        def run(batches):
            read, seen = _reader(chars, wanted), Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    seen.update(read(t))
            f = pa.array(list(seen), pa.int64() if wanted else pa.string())
            yield pa.RecordBatch.from_arrays([f, pa.array(list(seen.values()), pa.int64())], names=["f", "n"])

        schema = f"f {'long' if wanted else 'string'}, n long"
        return rows.where(F.col("toxic") == kind).select("text").mapInArrow(run, schema).groupBy("f").agg(F.sum("n").alias("n"))

    # candidates: what toxic rows of the bounded sample share; then how often the others have them
    least = max(3, n1 // 500)
    common = sorted(tuple(r) for r in counted(1, None).where(F.col("n") >= least).collect())
    candidates = [f for f, _ in common]
    index = {f: i for i, f in enumerate(candidates)}
    k = len(candidates)
    a, b = np.array([n for _, n in common]) + 0.5, np.full(k, 0.5)
    for r in counted(0, index).collect() if k else []:
        b[r.f] += r.n
    # not the z-score: in long texts common words are surely, but only a little, more frequent
    odds = np.log(a / (n1 + 1 - a) * (n0 + 1 - b) / b) - 2 * np.sqrt(1 / a + 1 / (n1 + 1 - a) + 1 / b + 1 / (n0 + 1 - b))
    best = [candidates[i] for i in np.lexsort((np.arange(k), -odds)) if odds[i] >= MIN_LOG_ODDS][:MAX_FEATURES]
    if not best:
        return flat
    index = {f: i for i, f in enumerate(best)}

    def numbered(batches):
        read = _reader(chars, index)
        for b in batches:
            found = [sorted(read(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    table = rows.mapInArrow(numbered, "toxic long, found array<int>").toArrow()
    y = (table.column("toxic").to_numpy() == 1).astype(float)
    found = table.column("found").combine_chunks()
    x = np.zeros((len(y), len(best)), np.uint8)
    x[np.repeat(np.arange(len(found)), found.value_lengths().to_numpy()), found.flatten().to_numpy()] = 1
    weights, intercept = _logistic(x, y)
    return ToxicityModel(chars, best, weights, intercept)


def score_texts(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row; null texts score as empty ones."""
    small_batches(docs.sparkSession)
    picked = docs.select(id_col, text_col)

    def run(batches):
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts are scored as texts without words; a null doc_id is never held out; repeated rows are scored each; an
    empty table gives no rows; other columns are ignored.
    """
    scored = score_texts(docs, fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; columns stay as they are.

    Null and empty texts are scored as texts without words, so they stay unless most labelled rows are toxic; repeated rows and rows
    without an id are scored each; an empty table gives no rows.
    """
    model = fit(docs, labels)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
