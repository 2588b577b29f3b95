"""Files that tasks read by ranges: local paths and the stores pyarrow knows. What it doesn't know, Spark's own readers still read whole."""

from __future__ import annotations

import re

from pyarrow import ArrowException, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI, or of a local path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:", uri) else (fs.LocalFileSystem(), uri)


def open_file(uri: str):
    """A seekable file."""
    store, path = locate(uri)
    return store.open_input_file(path)


def list_files(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of the files in a folder; empty ones and those with hidden names are left out."""
    store, base = locate(uri)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
    front = uri[: uri.index(base)] if base in uri else ""
    return sorted((front + f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))


def by_ranges(uri: str) -> bool:
    """Whether tasks can read parts of such a file."""
    try:
        open_file(uri).close()
    except (ArrowException, OSError, ValueError, ImportError):
        return False
    return True


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files that a path, folder or pattern names; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")
