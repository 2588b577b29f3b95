"""Nearest vectors by cosine, exactly: cells around pivots, of which only those are read that can hold a better match.

The evaluation set is the stated query set. Each of its vectors goes to the cell of its nearest pivot, and a cell knows the least and the
greatest angle to it. By the triangle inequality a vector at some angle to that pivot is no nearer to any vector of the cell than by how
far its angle lies outside that range; so a cell is compared with the rows alone whose best match so far, or the threshold, it could beat.
Cells are written to shared storage once and read there by the tasks that need them: training rows aren't shuffled, and the driver sees
the pivots and the ranges only. How much that spares depends on the data: vectors without clusters in many dimensions are all about as
far from each other, and at low thresholds every cell is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import scratch
from siftwell.sources.storage import list_files, open_file

#: Vectors of a cell on average, and the most cells.
CELL, MOST_CELLS = 1024, 256
#: Vectors that are compared at a time.
AT_ONCE = 2048
#: Bytes of cells that a task keeps.
KEPT = 256 << 20
#: Cosines no further apart than this are equal: the least eid wins.
SAME = 1e-12
_FOUND = "tid bigint, eid bigint, similarity double"


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).cast("long").alias(name), F.col("v").cast("array<double>").alias("v")).where(F.col(name).isNotNull() & F.col("v").isNotNull())


class _Cells:
    """The evaluation vectors of a cell in runs of AT_ONCE, kept while they fit."""

    def __init__(self, files: dict[int, list[str]]):
        self.files, self.held, self.bytes = files, {}, 0

    def runs(self, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if cell in self.held:
            yield from self.held[cell]
            return
        kept: list | None = []
        for path in self.files[cell]:
            with open_file(path) as file:
                for b in pq.ParquetFile(file).iter_batches(AT_ONCE, columns=["eid", "v"]):
                    run = b.column(0).to_numpy(), _unit(b.column(1))
                    yield run
                    size = run[1].nbytes
                    if kept is not None and self.bytes + size <= KEPT:
                        kept.append(run)
                        self.bytes += size
                    elif kept is not None:  # too large to be kept: read again each time
                        self.bytes -= sum(m.nbytes for _, m in kept)
                        kept = None
        if kept is not None:
            self.held[cell] = kept


def best_of(unit: np.ndarray, pivots: np.ndarray, ranges: np.ndarray, cells: _Cells, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The greatest cosine of each row and its least eid (-1 without one above the threshold), and how many pairs were compared."""
    n, pairs = len(unit), 0
    best, at = np.full(n, threshold), np.full(n, -1, np.int64)
    apart = _angles(unit, pivots)
    off = np.maximum(0, np.maximum(apart - ranges[:, 1], ranges[:, 0] - apart))
    bound = np.cos(np.maximum(off - 1e-7, 0))  # arccos is that exact
    for c in np.argsort(-bound.mean(0)):
        rows = np.flatnonzero(bound[:, c] >= best)
        if not len(rows):
            continue
        for eid, m in cells.runs(int(c)):
            s = unit[rows] @ m.T
            pairs += s.size
            top = s.max(1)
            first = eid[(s >= top[:, None] - SAME).argmax(1)]
            more = (top > best[rows] + SAME) | (at[rows] < 0) & (top > best[rows])
            tie = ~more & (at[rows] >= 0) & (top >= best[rows] - SAME) & (first < at[rows])
            at[rows[more | tie]] = first[more | tie]
            best[rows] = np.where(more | tie, np.maximum(top, best[rows]), best[rows])
    return best, at, pairs


def cosine_top1(train: DataFrame, evals: DataFrame, threshold: float = 0.95, cell: int = CELL) -> DataFrame:
    """(tid, eid, similarity): for each (tid, v) the most similar of (eid, v) above threshold, the least eid of ties.

    Null ids and vectors match nothing; a zero vector has a cosine of 0 with all; repeated tids are matched each. Without evaluation
    vectors there is no match.
    """
    spark = train.sparkSession
    evals = _named(evals, "eid")
    n = evals.count()
    if not n:
        return spark.createDataFrame([], _FOUND)
    count = min(MOST_CELLS, -(-n // cell))
    picked = evals.orderBy(F.xxhash64("eid"), "eid").limit(count).toArrow()
    pivots = _unit(picked.column("v").combine_chunks())

    def assign(batches):
        for b in batches:
            apart = _angles(_unit(b.column(1)), pivots)
            own = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(apart[np.arange(len(own)), own]), b.column(0), b.column(1)], names=["cell", "angle", "eid", "v"])

    path = scratch(spark, "vector-cells")
    parts = -(-n // 100_000)  # of a cell that has most of the vectors
    celled = evals.mapInArrow(assign, "cell int, angle double, eid bigint, v array<double>").repartition(count, "cell", F.pmod(F.xxhash64("eid"), F.lit(parts)))
    celled.sortWithinPartitions("cell", "eid").write.partitionBy("cell").parquet(path)
    known = spark.read.parquet(path).groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    ranges = np.full((count, 2), [np.inf, -np.inf])  # a cell without vectors is never near
    for r in known:
        ranges[r["cell"]] = r["low"], r["high"]
    files: dict[int, list[str]] = {}
    for name, _ in list_files(path):
        files.setdefault(int(name.split("/cell=")[1].split("/")[0]), []).append(name)

    def run(batches):
        cells = _Cells(files)
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                best, at, _ = best_of(_unit(part.column(1)), pivots, ranges, cells, threshold)
                hit = at >= 0
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(hit)), pa.array(at[hit]), pa.array(best[hit])], names=["tid", "eid", "similarity"])

    return _named(train, "tid").mapInArrow(run, _FOUND)
