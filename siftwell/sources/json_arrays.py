"""Rows of one huge JSON document, read by as many tasks as it has ranges of bytes.

Whether a byte stands in a string, and how deep in brackets, depends on all before it. So each range is first summed up for both cases,
that it starts in a string or not: the parity of its quotes and what its brackets add to the depth. Running sums over a file's ranges
then give the state at the start of each. With that, tasks find the arrays of the document's own keys (or the document itself, if it is a
list), and each range gives the objects that start in it, reading on past its end for the last one. Ranges never start behind a
backslash, so none starts in the middle of an escape.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.session import kept
from siftwell.sources.storage import file_sizes, open_file

#: Bytes of a range.
RANGE = 16 << 20

_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_BLANK = b" \t\r\n"
_BOM = b"\xef\xbb\xbf"


def _start(file, at: int, size: int) -> int:
    """The first place from a nominal one on that doesn't follow a backslash."""
    while 0 < at < size:
        file.seek(at - 1)
        before = file.read(4096)
        rest = before.lstrip(b"\\")
        at += len(before) - len(rest)
        if rest:
            break
    return min(at, size)


def _read(file, start: int, end: int) -> np.ndarray:
    file.seek(start)
    return np.frombuffer(file.read(end - start), np.uint8)


def _brackets(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets, whether an odd number of the range's quotes stands before each, and the number of quotes; escaped ones don't count."""
    quotes, slashes = np.flatnonzero(a == 34), np.flatnonzero(a == 92)
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) > 1)
        length = np.diff(first, append=len(slashes))
        escaped = slashes[first] + length
        quotes = np.setdiff1d(quotes, escaped[length % 2 == 1], assume_unique=True)
    at = np.flatnonzero(_STEP[a])
    return at, np.searchsorted(quotes, at) % 2 == 1, len(quotes)


def _placed(a: np.ndarray, in_string: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets that stand in no string, and the depth after each."""
    at, odd, _ = _brackets(a)
    at = at[odd == in_string]
    return at, depth + np.cumsum(_STEP[a[at]], dtype=np.int64)


def _top(file) -> tuple[int, bytes]:
    """The first character of a document, as its depth: objects of a list lie at depth 1, those of a key's array at depth 2."""
    file.seek(0)
    head = b""
    while not head.strip(_BLANK):
        more = file.read(4096)
        if not more:
            return 0, b""
        head = (head + more).removeprefix(_BOM)
    first = head.strip(_BLANK)[:1]
    return {b"[": 1, b"{": 2}.get(first, 0), first


def _key(file, at: int) -> str:
    """The key in front of the bracket at a place."""
    back = 4096
    while True:
        start = max(0, at - back)
        file.seek(start)
        text = file.read(at - start).rstrip(_BLANK).removesuffix(b":").rstrip(_BLANK)
        end = len(text) - 1
        i = text.rfind(b'"', 0, end)
        while i > 0 and (i - len(text[:i].rstrip(b"\\"))) % 2:
            i = text.rfind(b'"', 0, i)
        if i > 0 or start == 0:  # at the very start of what was read, backslashes may stand before
            return json.loads(text[i:])
        back *= 2


def _summed(batches):
    """A row for each range: where it really starts and ends, and its sums."""
    names = ["path", "nth", "start", "end", "quotes", "even", "odd"]
    for b in batches:
        out = []
        for path, nth, low, high in zip(*(c.to_pylist() for c in b.columns)):
            with open_file(path) as file:
                start, end = _start(file, low, file.size()), _start(file, high, file.size())
                a = _read(file, start, end)
                at, odd, quotes = _brackets(a)
                steps = _STEP[a[at]]
                out.append((path, nth, start, end, quotes, int(steps[~odd].sum()), int(steps[odd].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i else pa.string()) for i in range(7)], names=names)


def _bounds(batches):
    """The brackets that open or close an array of the document's: place, key if it opens, depth of its objects."""
    for b in batches:
        out = []
        for path, start, end, in_string, depth in zip(*(c.to_pylist() for c in b.columns)):
            with open_file(path) as file:
                base, _ = _top(file)
                a = _read(file, start, end)
                at, after = _placed(a, in_string, depth)
                kind = a[at]
                opens, closes = at[(kind == 91) & (after == base)], at[(kind == 93) & (after == base - 1)]
                for i in opens.tolist():
                    out.append((path, start + i, "" if base == 1 else _key(file, start + i), base))
                out += [(path, start + i, None, base) for i in closes.tolist()]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["path", "at", "key", "base"])


def objects(file, start: int, end: int, in_string: bool, depth: int, base: int, low: int, high: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the objects at a depth that start in a range and between two places."""
    a = _read(file, start, end)
    at, after = _placed(a, in_string, depth)
    kind = a[at]
    opens = at[(kind == 123) & (after == base + 1)]
    closes = at[(kind == 125) & (after == base)]
    opens = opens[(opens + start > low) & (opens + start < high)]
    data = a.tobytes()
    ends = np.searchsorted(closes, opens)
    for i, j in zip(opens.tolist(), ends.tolist()):
        if j < len(closes):
            yield start + i, data[i : closes[j] + 1]
        else:  # the last one goes on behind the range
            yield start + i, data[i:] + _rest(file, end, base, bool((in_string + _brackets(a)[2]) % 2), int(after[-1]), step)


def _rest(file, at: int, base: int, in_string: bool, depth: int, step: int) -> bytes:
    out, size = [], file.size()
    while at < size:
        end = _start(file, at + step, size)
        a = _read(file, at, end)
        places, after = _placed(a, in_string, depth)
        done = np.flatnonzero((a[places] == 125) & (after == base))
        if len(done):
            return b"".join([*out, a[: places[done[0]] + 1].tobytes()])
        out.append(a.tobytes())
        in_string, depth, at = bool((in_string + _brackets(a)[2]) % 2), int(after[-1]) if len(after) else depth, end
    raise ValueError("a JSON document that ends within an object")


def _objects(batches):
    for b in batches:
        for r in b.to_pylist():
            with open_file(r["path"]) as file:
                places, texts, held = [], [], 0
                for at, text in objects(file, r["start"], r["end"], r["in_string"], r["depth"], r["base"], r["low"], r["high"]):
                    places.append(at)
                    texts.append(text)
                    held += len(text)
                    if held > 8 << 20:
                        yield _texts(r["path"], places, texts)
                        places, texts, held = [], [], 0
                yield _texts(r["path"], places, texts)


def _texts(path: str, places: list[int], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["path", "at", "text"])


class JsonDocument:
    """The arrays of a JSON document, or of several with the same keys. Text is UTF-8; what isn't an object in an array gives no row."""

    def __init__(self, spark: SparkSession, path: str, range_bytes: int = RANGE):
        files = file_sizes(spark, path).where("length > 0")
        count = F.ceil(F.col("length") / range_bytes)
        nth = files.select("path", "length", F.explode(F.sequence(F.lit(0), (count - 1).cast("long"))).alias("nth"))
        ranges = nth.select("path", "nth", (F.col("nth") * range_bytes).alias("low"), F.least(F.col("length"), (F.col("nth") + 1) * range_bytes).alias("high"))
        # a task a range: the number of ranges is what the list of files says
        self._tasks = max(1, int(files.agg(F.sum(count)).first()[0] or 1))
        summed = ranges.repartition(self._tasks, "path", "nth").mapInArrow(_summed, "path string, nth long, start long, end long, quotes long, even long, odd long")
        before = Window.partitionBy("path").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
        strings = kept(summed, "json-ranges").withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
        adds = F.when(F.col("in_string"), F.col("odd")).otherwise(F.col("even"))
        deep = F.coalesce(F.sum(adds).over(before), F.lit(0)).alias("depth")
        self.ranges = kept(strings.select("path", "start", "end", "in_string", deep), "json-states")
        found = self.ranges.repartition(self._tasks, "path", "start").mapInArrow(_bounds, "path string, at long, key string, base long")
        close = F.lead("at").over(Window.partitionBy("path").orderBy("at"))
        cut = F.raise_error(F.lit("a JSON document that ends within an array")).cast("long")
        self.arrays = kept(found.withColumn("high", close).where("key IS NOT NULL").select("path", "key", F.col("at").alias("low"), F.coalesce("high", cut).alias("high"), "base"), "json-arrays")

    def keys(self) -> set[str]:
        """Keys whose values are arrays; the empty one if the document is a list."""
        return {r.key for r in self.arrays.select("key").distinct().collect()}

    def rows(self, key: str, schema: str, place: bool = False) -> DataFrame:
        """The objects of an array as rows of a schema, with place also file and at, where the object starts in it. A missing key gives none."""
        wanted = self.arrays.where(F.col("key") == key).drop("key")
        parts = self.ranges.join(wanted, "path").where("low < end AND high > start")
        texts = parts.repartition(self._tasks, "path", "start").mapInArrow(_objects, "path string, at long, text string")
        out = texts.select(F.from_json("text", schema).alias("r"), F.col("path").alias("file"), "at")
        return out.select("r.*", "file", "at") if place else out.select("r.*")


def document_kind(path: str) -> str:
    """The first character of a document."""
    with open_file(path) as file:
        return _top(file)[1].decode("utf-8", "replace")
