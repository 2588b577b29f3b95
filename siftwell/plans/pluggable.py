"""Extension points: functions of one's own run on distinct values or Arrow batches, never by row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_distinct(df: DataFrame, column: str, fn: Callable[[str], int | None], name: str) -> DataFrame:
    """fn over the distinct values of a column, joined back: each value is worked on once however often it occurs."""

    @F.pandas_udf("long")
    def call(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(v) for v in values], dtype="Int64")

    once = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, call(column))
    return df.join(once, column, "left")


def hash_images(files: DataFrame, fn: Callable[[bytes], int] | None = None) -> DataFrame:
    """(path, h, failed) of (path, bytes): a perceptual hash given as fn; without one the first 8 bytes of md5 (exact copies only)."""
    fn = fn or (lambda data: int.from_bytes(hashlib.md5(data).digest()[:8], "big", signed=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                try:
                    out.append(fn(data))
                except (ValueError, TypeError, OSError):  # an image that can't be read is told, not fatal
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64()), pa.array([x is None for x in out])], names=["path", "h", "failed"])

    return files.select("path", "bytes").mapInArrow(run, "path string, h bigint, failed boolean")


def dct_hash(gray: np.ndarray, size: int = 8, over: int = 4) -> int:
    """A perceptual hash of a gray image (rows of numbers) as a signed long: its mean over a grid of size * over cells a side, of that
    grid's cosine transform the size x size lowest frequencies, of those which lie above their median."""
    gray, n = np.asarray(gray, float), size * over
    if gray.ndim != 2 or 0 in gray.shape:
        raise ValueError("a gray image has rows and columns")

    def shrink(length: int) -> np.ndarray:
        """Weights of each pixel in each of n cells."""
        edges, at = np.arange(n + 1) * length / n, np.arange(length)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * n / length

    wave = np.cos(np.pi * np.arange(size)[:, None] * (2 * np.arange(n) + 1) / (2 * n))
    low = wave @ (shrink(gray.shape[0]) @ gray @ shrink(gray.shape[1]).T) @ wave.T
    bits = (low > np.median(low)).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def image_hasher(decode: Callable[[bytes], np.ndarray]) -> Callable[[bytes], int]:
    """A function for hash_images from any decoder of bytes to gray rows."""
    return lambda data: dct_hash(decode(data))


def embed(rows: DataFrame, fn: Callable[[list], list], key: str, value: str, batch: int = 64) -> DataFrame:
    """(key, v): an embedding of every row's value, fn getting at most ``batch`` at a time."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fn(part.column(1).to_pylist()), pa.list_(pa.float64()))], names=[key, "v"])

    return rows.select(key, value).mapInArrow(run, f"{key} {kind}, v array<double>")


def tokenize(df: DataFrame, column: str, fn: Callable[[str], list[int]], name: str = "token_ids") -> DataFrame:
    @F.pandas_udf("array<int>")
    def call(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(v) for v in values])

    return df.withColumn(name, call(column))


def topic_seed(seed: int, topic):
    """The first four bytes of sha256('seed:topic')."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), topic), 256), 1, 8), 16, 10).cast("bigint")
