"""Ranked lexical search: the best documents of each item by a saturated, length-normalized term weight, without scoring them all.

Documents are read once. What they hold of the items' vocabulary is staged as a forward index (a row for each document), from which all
else comes. For each term the index yields its k greatest impacts: an item with that term has k documents of at least the kth one, so
the kth impact of any of its terms is a lower bound of its kth score. The documents behind an item's strongest such terms are scored in
full, and the kth best of these scores, never less than the bound that led there, is the item's threshold.

An item's terms are ordered by frequency. The most frequent ones, as long as their greatest impacts together stay below the threshold,
can't bring a document that has none of the others up to it: they generate no candidates. What the other terms give a candidate is less than its score, so the kth best of that raises the
threshold once more. A candidate stays if what it has, and that bound on top, reaches the threshold, and is then scored in full. Nothing
that could be among the k best is left out.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, bounded_bytes, small_batches, stage

#: Bytes of UTF-8 to themselves, capital letters to small ones, all that separates terms to a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: As many of an item's terms seed its threshold.
SEED_TERMS = 4
#: Terms that generate no candidates add up to less than this share of the threshold: the more, the fewer postings are read, but the more
#: candidates get by without having nearly its score.
SPARED = 0.3
#: Up to so many rows and bytes, the items' terms travel to all tasks; beyond, documents are indexed whole and joins shuffle.
SMALL_ROWS, SMALL_BYTES = 200_000, 16 << 20

_INDEX = "doc_id long, n long, terms array<struct<term:binary,tf:int>>"
_LIST = pa.list_(pa.struct([("term", pa.binary()), ("tf", pa.int32())]))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_TERMS).split() if text else []


def _counted(texts: pa.Array, wanted: set[bytes] | None) -> tuple[pa.Array, pa.Array]:
    """How many terms each text has, and how often it has each (wanted) one."""
    totals, starts, terms, times = [], [0], [], []
    for text in texts.cast(pa.binary()).to_pylist():
        found = terms_of(text)
        totals.append(len(found))
        for term, tf in Counter(found).items():
            if wanted is None or term in wanted:
                terms.append(term)
                times.append(tf)
        starts.append(len(terms))
    pairs = pa.StructArray.from_arrays([pa.array(terms, pa.binary()), pa.array(times, pa.int32())], names=["term", "tf"])
    return pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs).cast(_LIST)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times) of items (item_id, text); equal rows are one item."""
    rows = items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id())
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), _counted(b.column("text"), None)[1]], names=["item", "item_id", "terms"])

    counted = rows.select("item", "item_id", "text").mapInArrow(run, f"item long, item_id {kind}, terms array<struct<term:binary,tf:int>>")
    return stage(counted.select("item", "item_id", F.inline("terms")).withColumnRenamed("tf", "times"), "item-terms")


def forward_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row, doc_id, n, terms) of each document with a term: n counts all its terms, terms has those of the vocabulary, or all of them
    if that isn't small."""
    small_batches(docs.sparkSession)
    size = vocabulary.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    wanted = {bytes(r.term) for r in vocabulary.collect()} if size[0] <= SMALL_ROWS and (size[1] or 0) <= SMALL_BYTES else None

    def run(batches):
        for b in batches:
            n, terms = _counted(b.column("text"), wanted)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, terms], names=["doc_id", "n", "terms"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX).where("n > 0")
    return stage(found.withColumn("row", F.monotonically_increasing_id()), "forward-index")


def _saturated(n_docs: int, n_terms: int) -> Column:
    """A posting's share of its term's weight, in whole millionths."""
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * (75L + (25L * n * {n_docs}L) div {n_terms}L))")


def _postings(index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    return index.select("row", "n", F.inline("terms")).select("row", "term", _saturated(n_docs, n_terms).alias("part"))


def _small(df: DataFrame) -> DataFrame:
    return bounded_bytes(df, SMALL_ROWS, F.octet_length("term"), SMALL_BYTES)


def _scores(pairs: DataFrame, index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(item, row, doc_id, score) of pairs (item, row), from all terms of the item."""
    there = bounded(pairs, 100_000)
    held = index.join(there, "row").select("item", "row", "doc_id", "n", F.inline("terms"))
    weights = _small(asked.select("item", "term", (F.col("times") * F.col("w")).alias("w")))
    each = held.withColumn("part", _saturated(n_docs, n_terms)).join(weights, ["item", "term"])
    return each.groupBy("item", "row", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))


def weighted(asked: DataFrame, index: DataFrame, n_docs: int, n_terms: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The items' terms with weight w, document frequency, greatest and kth impact; and each term's k rows of greatest impact."""
    postings = _postings(index, n_docs, n_terms)
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    # the limit of ranks is applied in each task before rows of a term meet
    order = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("part"), "row"))
    best = stage(postings.withColumn("r", order).where(F.col("r") <= k), "best-of-terms")
    ends = best.groupBy("term").agg(F.max("part").alias("top"), F.coalesce(F.max(F.when(F.col("r") == k, F.col("part"))), F.lit(0)).alias("kth"))
    w = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    own = F.col("times") * F.col("w")
    found = asked.join(counts, "term").join(ends, "term").withColumn("w", w)
    return stage(found.select("item", "item_id", "term", "times", "w", "df", (own * F.col("top")).alias("top"), (own * F.col("kth")).alias("kth")), "weighted-terms"), best


def thresholds(asked: DataFrame, best: DataFrame, index: DataFrame, n_docs: int, n_terms: int, k: int, seed_terms: int = SEED_TERMS) -> DataFrame:
    """(item, floor): a score that k documents reach, 0 where that isn't known."""
    strongest = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("kth"), "term"))
    seeds = asked.where("kth > 0").withColumn("s", strongest).where(F.col("s") <= seed_terms)
    pairs = stage(seeds.select("item", "term").join(best.select("term", "row"), "term").select("item", "row").distinct(), "seed-pairs")
    by_score = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    kth = _scores(pairs, index, asked, n_docs, n_terms).withColumn("r", by_score).where(F.col("r") == k)
    return kth.select("item", F.col("score").alias("floor"))


def generators(asked: DataFrame, floors: DataFrame, spared: float = SPARED) -> DataFrame:
    """The terms that generate candidates, with the item's floor and what its other terms can add to a candidate at most (rest)."""
    both = asked.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    by_frequency = Window.partitionBy("item").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    split = both.withColumn("needed", F.sum("top").over(by_frequency) >= F.col("floor") * spared)
    rest = F.coalesce(F.sum(F.when(~F.col("needed"), F.col("top"))).over(Window.partitionBy("item")), F.lit(0))
    return split.withColumn("rest", rest).where("needed AND w > 0").select("item", "term", (F.col("times") * F.col("w")).alias("w"), "floor", "rest")


def candidates(gens: DataFrame, index: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, row) of the documents that may be among the k best: what the generating terms give them is a score that they reach at
    least, so its kth best raises the floor."""
    hits = _postings(index, n_docs, n_terms).join(_small(gens), "term")
    sums = hits.groupBy("item", "row").agg(F.sum(F.col("w") * F.col("part")).alias("part"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    near = stage(sums.where(F.col("part") + F.col("rest") >= F.greatest("floor", F.lit(1))), "near-documents")
    by_part = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part")))
    raised = near.select("item", "part").withColumn("r", by_part).where(F.col("r") == k).select("item", F.col("part").alias("raised"))
    found = near.join(bounded(raised, SMALL_ROWS), "item", "left")
    return found.where(F.col("part") + F.col("rest") >= F.coalesce("raised", F.lit(1))).select("item", "row")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, those with a score above 0.

    Equal scores rank by doc_id, null ids last. Null and empty texts have no terms, so such documents count nowhere and such items get
    no rows, as do items whose terms no document has. Each row of docs is a document of its own, also where an id or the whole row is
    repeated; equal rows of items are one item, other texts with the same item_id are ranked each. Empty tables give no rows; other
    columns are ignored.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = item_terms(items)
    index = forward_index(docs, asked.select("term").distinct())
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    asked, best = weighted(asked, index, n_docs, n_terms, k)
    floors = thresholds(asked, best, index, n_docs, n_terms, k)
    found = stage(candidates(stage(generators(asked, floors), "generators"), index, n_docs, n_terms, k), "candidates")
    scored = _scores(found, index, asked, n_docs, n_terms)
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    ranked = scored.where("score > 0").withColumn("rank", order).where(F.col("rank") <= k)
    names = bounded(asked.select("item", "item_id").distinct(), SMALL_ROWS)
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_SMALL_LETTERS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_SMALL_LETTERS}, {_TERM}) AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sizes) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_SMALL_LETTERS}, {_TERM})) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
