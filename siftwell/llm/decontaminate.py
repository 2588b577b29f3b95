"""Benchmark decontamination, in DataFrame functions only.

1. Screen, without loss: a window as long as an item can only be similar enough if it holds enough shingles of items of that
   length. Shingle hashes of all documents meet those of the benchmark, and only starts with enough of them stay.
2. Those item-sized windows get a SimHash of BITS bits over their shingles, repeats weighing as often as they occur. A text shorter
   than the item is one window of its whole length.
3. Multi-index Hamming blocks of BLOCK bits. A similar window differs from its item in a bounded number of shingles, so a bit whose
   votes outweigh that number can't change: each item emits, for the block with most such bits, all values that differ in the others.
   Windows emit their blocks as they are and meet it there. Of items of so many shingles that too few bits are beyond that number, or
   where keys take less than it (SWAY), the windows of their length are tried each. Pairs that agree on all bits that can't change go on.
4. The exact weighted Jaccard similarity of the shingle multisets decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import stage, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint and of a block.
BITS = 256
BLOCK = 16
#: Votes move by at most the number of shingles that differ. Keys take the less of it and so many of its standard deviations, which
#: would lose about 1 window in 500; so items where that is less have no keys in the search, and meet all windows of their length.
SWAY = 3.0
#: Broadcast a side only up to so many rows (of a few long columns); else it is shuffled.
BROADCAST_ROWS = 500_000


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _shingles(h: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array column of word hashes; empty if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(h) - k)
    gram = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return F.when(F.size(h) >= k, gram).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(text: str) -> Column:
    return F.transform(words_of(F.lower(F.col(text))), lambda x: F.xxhash64(x))


def with_votes(df: DataFrame, shingles: str) -> DataFrame:
    """df with counts, an array of BITS counts: how many of an array of hashes have each bit, of theirs or of them hashed again.

    Bits b and b + 32 are counted in one long. Each array of hashes is named twice, which keeps it from being merged into the lambda
    that reads it and computed for each bit.
    """
    again = [f"__hashes{t}" for t in range(1, BITS // 64)]
    df = df.withColumns({name: F.transform(shingles, lambda x: F.xxhash64(x, F.lit(name))) for name in again})

    def word(of: str) -> Column:
        lanes = F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda b: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(0x0000000100000001))),
        )
        return F.when(F.size(of) >= 0, lanes)

    df = df.withColumns({f"__lanes{t}": word(name) for t, name in enumerate([shingles, *again])})
    low, high = (lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda v: F.shiftrightunsigned(v, 32))
    counts = F.concat(*[F.transform(f"__lanes{t}", half) for t in range(BITS // 64) for half in (low, high)])
    return df.withColumn("counts", counts).drop(*again, *[f"__lanes{t}" for t in range(BITS // 64)])


def block_values(counts: str, n: str) -> Column:
    """Array of the BITS / BLOCK blocks of a fingerprint from its votes: a bit is 1 if over half the n shingles have it."""

    def value(j: int) -> Column:
        ones = F.transform(F.slice(counts, j * BLOCK + 1, BLOCK), lambda c, i: F.when(2 * c > F.col(n), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
        return F.aggregate(ones, F.lit(0), lambda a, x: a.bitwiseOR(x))

    return F.array(*[value(j) for j in range(BITS // BLOCK)])


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _differ(similarity: float) -> Column:
    """Most shingles that an item of n has and a similar enough window lacks, or the other way round."""
    return F.floor(2 * F.col("n") * (1 - similarity) / (1 + similarity) + F.lit(1e-9))


def keeps_all(similarity: float, sway: float = SWAY) -> Column:
    """Whether the keys of an item of n shingles meet every similar enough window."""
    return _differ(similarity) <= F.lit(sway) * F.sqrt(_differ(similarity))


def fixed_bits(similarity: float) -> Column:
    """For each block of an item (n, counts) a mask of the bits that no similar enough window has otherwise."""
    margin, most = (lambda c: 2 * c - F.col("n")), _differ(similarity)

    def mask(j: int) -> Column:
        ones = F.transform(F.slice("counts", j * BLOCK + 1, BLOCK), lambda c, i: F.when((margin(c) > most) | (margin(c) <= -most), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
        return F.aggregate(ones, F.lit(0), lambda a, x: a.bitwiseOR(x))

    return F.array(*[mask(j) for j in range(BITS // BLOCK)])


def _agree(a: str, b: str, mask: str) -> Column:
    return F.forall(F.zip_with(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), mask, lambda d, m: d.bitwiseAND(m)), lambda x: x == 0)


def item_keys(items: DataFrame, similarity: float, sway: float = SWAY) -> DataFrame:
    """items (with n, the number of shingles, counts and fp) with block and value of every key that they emit."""
    differ = _differ(similarity)
    bound = F.least(differ.cast("double"), F.lit(sway) * F.sqrt(differ))
    open_bits = F.transform("counts", lambda c: (2 * c - F.col("n") <= F.col("sway")) & (2 * c - F.col("n") > -F.col("sway")))
    of_block = F.transform(
        F.sequence(F.lit(0), F.lit(BITS // BLOCK - 1)),
        lambda j: F.struct(F.size(F.filter(F.slice("open", j * BLOCK + 1, BLOCK), lambda o: o)).alias("n_open"), j.alias("block")),
    )
    best = items.withColumn("sway", bound).withColumn("open", open_bits).withColumn("block", F.array_min(of_block)["block"])
    here = F.transform(F.slice("open", F.col("block") * BLOCK + 1, BLOCK), lambda o, i: F.when(o, F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    flips = F.aggregate(F.filter(here, lambda x: x > 0), F.array(F.lit(0)), lambda have, bit: F.concat(have, F.transform(have, lambda x: x.bitwiseOR(bit))))
    return best.select(*items.columns, "block", F.explode(flips).alias("flip")).withColumn("value", F.get("fp", F.col("block")).bitwiseXOR(F.col("flip"))).drop("flip")


def _overlap(a: str, b: str) -> Column:
    """Size of the intersection of two arrays as multisets."""

    def times(x: Column, of: str) -> Column:
        return F.size(F.filter(of, lambda y: y == x))

    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(x, a), times(x, b)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _pick(k: Column, by: dict[int, Column]) -> Column:
    """The column for the value of k."""
    out = F.lit(None)
    for value, column in by.items():
        out = F.when(k == value, column).otherwise(out)
    return out


def _candidates(keyed: DataFrame, items: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """(id, text_key, n_words, n, m, starts): where windows of m shingles may be similar enough to items of n shingles, n_words words."""
    marks = _bounded(items.select("n_words", F.explode(F.array_distinct("item_grams")).alias("gram")).distinct())
    hashed = keyed.select("id", "text_key", _word_hashes("text").alias("h")).withColumn("n_text", F.size("h"))
    seeds = None
    for k in sizes:  # 1 to SHINGLE; a shingle's hash tells its number of words
        one = hashed.select("id", "text_key", "n_text", F.posexplode(_shingles("h", k)).alias("at", "gram")).join(marks.where(F.least("n_words", F.lit(SHINGLE)) == k), "gram")
        seeds = one if seeds is None else seeds.unionByName(one)
    held = seeds.groupBy("id", "text_key", "n_text", "n_words").agg(F.sort_array(F.collect_set("at")).alias("p"))
    short = F.least("n_words", F.lit(SHINGLE)) - 1
    n, m = F.col("n_words") - short, F.least("n_words", "n_text") - short
    need = F.ceil(similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9).cast("int")
    held = held.select("*", n.alias("n"), m.alias("m")).withColumn("need", need).where("size(p) >= need")
    spans = F.transform(F.slice("p", 1, F.size("p") - F.col("need") + 1), lambda a, j: F.struct(a.alias("a"), F.get("p", j + F.col("need") - 1).alias("b")))
    close = F.filter(spans, lambda s: s["b"] - s["a"] < F.col("m"))
    starts = F.array_distinct(F.flatten(F.transform(close, lambda s: F.sequence(F.greatest(F.lit(0), s["b"] - F.col("m") + 1), F.least(s["a"], F.col("n_text") - F.least("n_words", "n_text"))))))
    return held.where(F.size(close) > 0).select("id", "text_key", "n_words", "n", "m", starts.alias("starts")).where("size(starts) > 0")


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, similarity: float) -> DataFrame:
    """(id_col, text_key, item_id, start_word, n_words, distance, similarity) of every window that is similar enough to an item."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    h = benchmark.select(F.col(item_col).alias("item_id"), _word_hashes("text").alias("h")).where("size(h) > 0").withColumn("n_words", F.size("h"))
    k = F.least("n_words", F.lit(SHINGLE))
    items = h.select("item_id", "n_words", _pick(k, {x: _shingles("h", x) for x in range(1, SHINGLE + 1)}).alias("item_grams")).withColumn("n", F.size("item_grams"))
    items = stage(with_votes(items, "item_grams").withColumn("fp", block_values("counts", "n")).withColumn("fixed", fixed_bits(similarity)), "item-prints")
    sizes = sorted(r.k for r in items.select(k.alias("k")).distinct().collect())
    if not sizes:
        none = keyed.select("id", "text_key").where("false").crossJoin(items.select("item_id").where("false"))
        return none.select("id", "text_key", "item_id", *[F.lit(0).alias(x) for x in ("n_words", "start_word", "distance")], F.lit(0.0).alias("similarity"))
    c = _bounded(stage(_candidates(keyed, items, sizes, similarity), "windows")).withColumnsRenamed({"id": "cid", "text_key": "ckey"})
    again = keyed.join(c, (F.col("text_key") == F.col("ckey")) & F.col("id").eqNullSafe(F.col("cid")))
    names = ["id", "text_key", "n_words", "n", "m"]
    again = again.select(*names, "starts", _word_hashes("text").alias("h")).select(*names, "starts", _pick(k, {x: _shingles("h", x) for x in sizes}).alias("grams"))
    windows = again.select(*names, "grams", F.explode("starts").alias("start_word"))
    windows = windows.select(*names, "start_word", F.slice("grams", F.col("start_word") + 1, F.col("m")).alias("win")).where("size(win) = m")
    prints = stage(with_votes(windows, "win").withColumn("win_fp", block_values("counts", "m")).drop("counts"), "window-prints")
    left = prints.select("*", F.posexplode("win_fp").alias("block", "value"))
    right = stage(item_keys(items.where(keeps_all(similarity)).select("item_id", "n_words", "n", "counts", "fp"), similarity).select("item_id", "n_words", "block", "value"), "item-keys")
    told = items.select(F.col("item_id").alias("__item"), F.col("n_words").alias("__n"), keeps_all(similarity).alias("keyed"), "item_grams", "fp", "fixed")
    met = left.join(_bounded(right), ["n_words", "block", "value"])  # an item has one block, so a pair meets once
    met = met.join(_bounded(told), F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("n_words") == F.col("__n")))
    tried = prints.join(_bounded(told.where("NOT keyed")), F.col("n_words") == F.col("__n")).withColumn("item_id", F.col("__item"))
    names = [*names, "start_word", "win", "win_fp", "item_id", "item_grams", "fp", "fixed"]
    pairs = met.select(*names).unionByName(tried.select(*names))
    near = pairs.where(_agree("fp", "win_fp", "fixed")).withColumn("distance", _distance("fp", "win_fp"))
    shared = near.select("id", "text_key", "item_id", "n_words", "n", "m", "start_word", "distance", _overlap("win", "item_grams").alias("o"))
    return shared.withColumn("similarity", F.col("o") / (F.col("n") + F.col("m") - F.col("o"))).where(F.col("similarity") >= similarity).drop("o", "n", "m")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """For each document and item with a similar enough window the best one, the first of ties: (id_col, item_id, start_word,
    n_words, distance, similarity). start_word counts words from 0.

    Words are lower-cased. Shingles are of SHINGLE words, or of the whole item where that is shorter. A text shorter than an item is
    compared as a whole. Null and blank texts match nothing, on either side; repeated rows count once; a null id is returned as null; other columns are ignored.
    """
    hits = _leaks(docs, benchmark, id_col, text_col, item_col, similarity)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back"), "n_words", "distance")).alias("best")
    out = hits.groupBy(F.col("id").alias(id_col), "item_id").agg(best)
    return out.select(id_col, "item_id", (-F.col("best.back")).alias("start_word"), "best.n_words", "best.distance", "best.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that hold an item's passage; all else stays as it is, null texts and extra columns too."""
    hits = _leaks(docs, benchmark, id_col, text_col, item_col, similarity)
    bad = _bounded(stage(hits.select(F.col("id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "leaks"))
    return docs.join(bad, (F.xxhash64(text_col) == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
