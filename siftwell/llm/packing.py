"""Shortest-pack-first packing over the length histogram.

Documents become token pieces of at most SEQ_LEN ids. Only the histogram of lengths (at most SEQ_LEN x SALTS counts) reaches the
driver, which places lengths longest first: each takes the currently shortest packs with room, whole groups of equal packs at a
time, and the packing patterns' counts are updated. The plan is a table of slots; pieces find theirs by (length, rank).
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import small_batches, stage
from siftwell.llm.token_files import encoder

SEQ_LEN = 2048
WORD_BPE = "word_bpe_49k.json"
WORD_BPE_END = 1
#: Ranks within one length are counted in at least so many independent runs where it is common, and in runs of at most about RUN
#: pieces, so that one very common length is not one task's work at any size.
SALTS = 64
RUN = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, drops_space: bool = True) -> DataFrame:
    """PIECES rows: each document's ids and its end id, cut every seq_len. Null texts count as empty and hold the end id alone."""
    small_batches(docs.sparkSession, 4000, 12)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        enc = encoder(tokenizer_path, drops_space)
        for b in batches:
            ids, counts = enc.encode(b.column(1))
            ids, counts = np.insert(ids, np.cumsum(counts), enc.kind.type(end_id)).astype("<u4"), counts + 1
            pieces = -(-counts // seq_len)
            doc = np.repeat(np.arange(len(counts)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * seq_len
            length = np.minimum(seq_len, counts[doc] - start)
            at = (np.cumsum(counts) - counts)[doc] + start
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, counts[doc]))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return picked.mapInArrow(run, PIECES)


def plan_packs(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first_rank, count, each, first_sequence, offset): the count pieces of that length ranked from first_rank
    on go, ``each`` to a pack, into the packs from first_sequence on, starting at offset there.

    Lengths are placed longest first. A pattern stands for equal packs: (used, key, packs, members). A length goes to the
    shortest pattern while that has room, as many to a pack as fit, and opens full packs of its own only when none has. Each step
    takes a whole pattern or splits one in two, so the work depends on the number of lengths, not of pieces.
    """
    open_, full, key = [], [], 0  # open_ is sorted by used

    def put(used: int, packs: int, members: list) -> None:
        nonlocal key
        key += 1
        full.append((packs, members)) if used == seq_len else insort(open_, (used, key, packs, members))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if open_ and open_[0][0] + length <= seq_len:
                used, _, packs, members = open_.pop(0)
                if left < packs:
                    put(used, packs - left, [(n, first + left * each, each, at) for n, first, each, at in members])
                    packs = left
                each = min((seq_len - used) // length, left // packs)
            else:
                used, members, each = 0, [], min(seq_len // length, left)
                packs = left // each
            put(used + each * length, packs, [*members, (length, rank, each, used)])
            left -= packs * each
            rank += packs * each
    slots, sequence = [], 0
    for packs, members in full + [(packs, members) for _, _, packs, members in open_]:
        slots += [(length, first, packs * each, each, sequence, at) for length, first, each, at in members]
        sequence += packs
    return slots


def pack_pieces(pieces: DataFrame, seq_len: int = SEQ_LEN, salts: int = SALTS) -> DataFrame:
    """pieces (PIECES, written once: they are read twice) with sequence_id and offset; offsets are gapless from 0."""
    spark = pieces.sparkSession
    sizes = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most seq_len
    often = F.create_map(*[F.lit(x) for length, n in sizes.items() if n > RUN * salts for x in (length, -(-n // RUN))] or [F.lit(-1).cast("long"), F.lit(1)])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.coalesce(F.try_element_at(often, F.col("length")), F.lit(salts)).cast("long")))
    counts = sorted(tuple(r) for r in salted.groupBy("length", "salt").count().collect())
    histogram: dict[int, int] = {}
    base = []
    for length, salt, n in counts:
        base.append((length, salt, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    slots = plan_packs(histogram, seq_len)
    # both tables are bounded by the histogram: at most seq_len x salts, one for each RUN pieces, and a few x seq_len rows
    base_df = F.broadcast(spark.createDataFrame(base, "length long, salt long, base long"))
    slots_df = F.broadcast(spark.createDataFrame(slots, "slot_length long, first_rank long, n long, each long, first_sequence long, at long"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1).join(base_df, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    nth = F.col("rank") - F.col("first_rank")
    return ranked.join(slots_df, fits).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = WORD_BPE_END, seq_len: int = SEQ_LEN) -> DataFrame:
    """One row a piece of every document with its place. Repeated rows are packed each; null ids and texts are packed too
    (a null text as its end id alone); an empty table gives no rows; other columns are ignored."""
    pieces = stage(token_pieces(docs, tokenizer_path or public_tokenizers.path(WORD_BPE), end_id, seq_len=seq_len), "pieces")
    return pack_pieces(pieces, seq_len)
