"""Language of texts by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time: two layers of gated recurrent units read a window of WINDOW
bytes from either end, and a softmax over both states labels every byte. A text is cut into such windows, each byte in one of them; the means of
its bytes' probabilities are the document's. Training sees a bounded sample of labelled documents; every text is labelled whole.

Arrays are (features, ..., windows), so that gates are contiguous and one step of all windows is a few calls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, small_batches

#: Bytes of a window, and states in a direction.
WINDOW, HIDDEN = 64, 8
#: The sample that a model is fitted on: so many documents of a language in expectation, so many windows of a document.
DOCS_PER_LANG, WINDOWS_PER_DOC = 1000, 8
#: Training: steps, windows in a step, rate of the optimizer at the start.
STEPS, BATCH, RATE = 300, 256, 0.02
#: Windows that are labelled at a time, which bounds memory.
AT_ONCE = 512
UNKNOWN = "und"

Params = dict[str, np.ndarray]


def init(classes: int, hidden: int = HIDDEN, seed: int = 7) -> Params:
    """Weights to start from: for each direction d, in_d (a column a byte), rec_d and bias_d of the gates (update, reset, new); out and shift."""
    rnd = np.random.default_rng(seed)
    p = {}
    for d in ("f", "b"):
        p[f"in_{d}"] = rnd.normal(0, 0.3, (3 * hidden, 256))
        p[f"rec_{d}"] = rnd.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        p[f"bias_{d}"] = np.zeros((hidden, 1))
    p["out"] = rnd.normal(0, 0.3, (classes, 2 * hidden))
    p["shift"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): in place of tanh, and halved and raised by a half of the logistic function, at a quarter of the time. Its slope is (1 - |y|) ** 2."""
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=y)


def _read(p: Params, d: str, x: np.ndarray, there: np.ndarray, out: np.ndarray, kept: list | None = None) -> None:
    """Put states into out (hidden, steps, windows) after each byte of x (steps, windows), read from the front (f) or the back (b). Bytes
    that aren't there leave a zero state. kept gets what the way back needs."""
    table, rec, bias = p[f"in_{d}"], p[f"rec_{d}"], p[f"bias_{d}"]
    k = rec.shape[1]
    steps, n = x.shape
    h = np.zeros((k, n), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g = np.take(table, x[t], axis=1, mode="clip")  # every index is a byte; clip only saves the check
        a = rec @ h
        g[: 2 * k] += a[: 2 * k]
        zr = _soft(g[: 2 * k])
        zr *= 0.5
        zr += 0.5
        z, r = zr[:k], zr[k:]
        q = a[2 * k :]
        q += bias
        new = _soft(g[2 * k :] + r * q)
        if kept is not None:
            kept.append((t, h, z, r, q, new))
        h = h - new
        h *= z
        h += new
        h *= there[t]
        out[:, t] = h


def _back(p: Params, d: str, x: np.ndarray, there: np.ndarray, kept: list, dout: np.ndarray) -> Params:
    """Gradients of a direction's weights, from those of its states."""
    rec = p[f"rec_{d}"]
    k = rec.shape[1]
    drec, dbias = np.zeros_like(rec), np.zeros_like(p[f"bias_{d}"])
    dx = np.empty((3 * k, *x.shape), np.float32)
    dh = np.zeros((k, x.shape[1]), np.float32)
    for t, before, z, r, q, new in reversed(kept):
        dh = (dh + dout[:, t]) * there[t]
        dnew = dh * (1 - z) * (1 - np.abs(new)) ** 2
        gates = [(1 - np.abs(2 * y - 1)) ** 2 / 2 for y in (z, r)]
        da = np.concatenate([dh * (before - new) * gates[0], dnew * q * gates[1], dnew * r])
        dx[: 2 * k, t], dx[2 * k :, t] = da[: 2 * k], dnew
        drec += da @ before.T
        dbias += da[2 * k :].sum(1, keepdims=True)
        dh = dh * z + rec.T @ da
    flat = x.ravel()
    din = np.stack([np.bincount(flat, row.ravel(), 256) for row in dx])
    return {f"in_{d}": din, f"rec_{d}": drec, f"bias_{d}": dbias}


def probabilities(p: Params, x: np.ndarray, there: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """(classes, steps, windows): the probability of each class at each byte."""
    k = p["rec_f"].shape[1]
    states = np.empty((2 * k, *x.shape), np.float32)
    for d, part in (("f", states[:k]), ("b", states[k:])):
        _read(p, d, x, there, part, None if kept is None else kept.setdefault(d, []))
    if kept is not None:
        kept["states"] = states
    y = (p["out"] @ states.reshape(len(states), -1) + p["shift"]).reshape(-1, *x.shape)
    y -= y.max(0)
    np.exp(y, out=y)
    y /= y.sum(0)
    return y


def gradients(p: Params, x: np.ndarray, there: np.ndarray, label: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over all bytes that are there, and its gradients."""
    kept: dict = {}
    y = probabilities(p, x, there, kept)
    n = there.sum()
    at = np.arange(len(label))
    loss = float(-(np.log(y[label, :, at].T + 1e-12) * there).sum() / n)
    y[label, :, at] -= 1
    y *= there / n
    flat, states = y.reshape(len(y), -1), kept["states"]
    g = {"out": flat @ states.reshape(len(states), -1).T, "shift": flat.sum(1, keepdims=True)}
    dstates = (p["out"].T @ flat).reshape(states.shape)
    k = len(states) // 2
    return loss, g | _back(p, "f", x, there, kept["f"], dstates[:k]) | _back(p, "b", x, there, kept["b"], dstates[k:])


def train(windows: list[bytes], labels: np.ndarray, classes: int, steps: int = STEPS, seed: int = 7) -> Params:
    """Adam over batches in which every class is equally likely; the rate falls to zero in a cosine."""
    p, rnd = init(classes, seed=seed), np.random.default_rng(seed)
    x, there = _grid(windows)
    of = [np.flatnonzero(labels == c) for c in range(classes)]
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for i in range(1, steps + 1):
        label = rnd.integers(0, classes, BATCH)
        pick = np.array([of[c][rnd.integers(len(of[c]))] for c in label])
        _, g = gradients(p, x[:, pick], there[:, pick], label)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * (1 + np.cos(np.pi * i / steps)) / 2
        for k in p:
            v = g[k] * min(1.0, 1 / (norm + 1e-12))
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            p[k] -= (rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return p


def _grid(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (steps, windows) of windows, and 1 where there is one."""
    x = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW).T
    return x, (np.arange(WINDOW)[:, None] < np.array([len(w) for w in windows])[None, :]).astype(np.float32)


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) of all texts' bytes, the length of each window and the text that it is of."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // WINDOW)
    flat = np.zeros((int(count.sum()), WINDOW), np.uint8)
    start = np.cumsum(count) - count
    for t, s, c in zip(texts, start, count):
        flat[s : s + c].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
    of = np.repeat(np.arange(len(texts)), count)
    return flat, np.minimum(WINDOW, sizes[of] - (np.arange(len(of)) - start[of]) * WINDOW), of


class LanguageModel:
    """A trained network and the names of its classes."""

    def __init__(self, names: list[str], params: Params | None):
        self.names, self.params = names, params

    def label(self, texts: list[bytes]):
        """For runs of windows: the probabilities of their bytes (classes, steps, windows), which bytes are there, and the windows' texts."""
        flat, sizes, of = _cut(texts)
        for i in range(0, len(flat), AT_ONCE):
            there = (np.arange(WINDOW)[:, None] < sizes[None, i : i + AT_ONCE]).astype(np.float32)
            x = np.ascontiguousarray(flat[i : i + AT_ONCE].T).astype(np.intp)
            y = probabilities(self.params, x, there) if self.params is not None else np.ones((1, *x.shape), np.float32)
            yield y, there, of[i : i + AT_ONCE]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, classes): means over all bytes of a text."""
        sums = np.zeros((len(texts), len(self.names)))
        for y, there, of in self.label(texts):
            y *= there
            for c, row in enumerate(y.sum(1)):
                sums[:, c] += np.bincount(of, row, len(texts))
        return sums / np.maximum([[len(t)] for t in texts], 1)


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, windows): evenly spread windows of DOCS_PER_LANG documents of a language in expectation, picked by a hash of doc_id, none of them held out."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~_held_out()).select("lang", "doc_id", "text")
    share = known.groupBy("lang").agg((F.lit(DOCS_PER_LANG) / F.count("*") * 2.0**53).alias("share"))
    texts = known.join(bounded(share, 100_000), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(2**53)) < F.col("share")).drop("share")

    def run(batches):
        for b in batches:
            found = []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                n = len(t or b"")
                starts = sorted({i * max(n - WINDOW, 0) // max(WINDOWS_PER_DOC - 1, 1) for i in range(WINDOWS_PER_DOC)}) if n else []
                found.append([t[s : s + WINDOW] for s in starts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], names=["lang", "doc_id", "windows"])

    cut = texts.mapInArrow(run, f"lang string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, windows array<binary>")
    return cut.groupBy("lang", "doc_id").agg(F.min("windows").alias("windows")).select("lang", "doc_id", "windows")


def fit(docs: DataFrame, steps: int = STEPS) -> LanguageModel:
    """A network fitted on docs (doc_id, text, lang), less the held-out fold. Only the bounded sample reaches the driver.

    Null texts, languages and ids are left out; of rows that repeat an id and a language one counts. Without labelled texts no language
    is known; with one language there is nothing to train.
    """
    small_batches(docs.sparkSession)
    rows = sorted((r.lang, r.doc_id, r.windows) for r in training_windows(docs).collect())
    names = sorted({lang for lang, _, found in rows if found})
    if len(names) < 2:
        return LanguageModel(names, None)
    windows = [bytes(w) for _, _, found in rows for w in found]
    labels = np.array([names.index(lang) for lang, _, found in rows for _ in found])
    return LanguageModel(names, train(windows, labels, len(names), steps))


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row: the language whose mean probability over the text's bytes is highest, ties by name.

    A text that is null, empty or has no letter is und with score 0, and so is every text if the model knows no language. Repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(id_col, text_col)

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            known = [bool(model.names) and _has_letter(t) for t in texts]
            pooled = model.pooled([t if k else b"" for t, k in zip(texts, known)])
            best = pooled.argmax(1) if model.names else []
            named = [model.names[best[i]] if k else UNKNOWN for i, k in enumerate(known)]
            score = [min(1.0, float(pooled[i, best[i]])) if k else 0.0 for i, k in enumerate(known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(named, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def label_bytes(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, runs) for every row: runs of bytes (start, end, lang) with the same likeliest language, in order.

    A null or empty text has no runs, and no text has any if the model knows no language.
    """
    small_batches(docs.sparkSession, rows=50)
    picked = docs.select(id_col, text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            marks: list[list[np.ndarray]] = [[] for _ in texts]
            for y, there, of in model.label(texts) if model.names else ():
                best = y.argmax(0)
                for j, i in enumerate(of):
                    marks[i].append(best[: int(there[:, j].sum()), j])
            found = []
            for m in marks:
                m = np.concatenate(m) if m else np.zeros(0, int)
                cuts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)] if len(m) else []
                found.append([{"start": s, "end": e, "lang": model.names[m[s]]} for s, e in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=[id_col, "runs"])

    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, runs array<struct<start:bigint,end:bigint,lang:string>>")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs; a null doc_id is never held out, nor learned from. See fit and identify."""
    found = identify(docs, fit(docs))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
