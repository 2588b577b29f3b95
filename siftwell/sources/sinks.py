"""Writers: JSON lines, CSV with stated or united headers, nested parquet, JSON and Markdown reports of small results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.projections import flatten


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> str:
    """One folder of JSON lines (nulls left out), split by a column if one is named."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).json(path)
    return path


def write_findings(findings: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Findings as JSON lines; their counts by layer, and the gate's code."""
    findings.write.json(path)
    stored = findings.sparkSession.read.schema(findings.schema).json(path)
    counts = stored.groupBy("layer").agg(F.count("*").alias("n"))
    return counts, int(stored.limit(1).count() > 0)


def write_train(df: DataFrame, path: str) -> str:
    """Nested parquet, zstd; an empty table raises and leaves nothing."""
    if not df.limit(1).count():
        raise ValueError("no training rows")
    df.write.option("compression", "zstd").parquet(path)
    return path


def write_csv(df: DataFrame, path: str, first: Sequence[str] = (), order: str = "sorted") -> str:
    """One CSV file of a small table: struct leaves as columns; first, then the rest sorted or as they stand."""
    flat = flatten(df)
    rest = [c for c in flat.columns if c not in first]
    names = [*first, *(sorted(rest) if order == "sorted" else rest)]
    flat.select(*[F.col(f"`{c}`") for c in names]).coalesce(1).write.option("header", True).csv(path)
    return path


def pivot_steps(series: DataFrame) -> DataFrame:
    """(step, a column a metric): the header is the sorted union of metrics, a bounded vocabulary."""
    return series.groupBy("step").pivot("metric").agg(F.max("value"))


def json_report(df: DataFrame, name: str = "report") -> DataFrame:
    """Rows as JSON documents."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A Markdown table of a small result; None as a dash. More rows than the limit raise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report holds at most {limit} rows")
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows), ""])


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(line): columns padded to their widths, nulls as dashes."""
    from siftwell.functions.text import fixed

    cells = []
    for c, kind in df.dtypes:
        cell = fixed(F.col(c)) if kind in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("-"))
        cells.append(F.rpad(cell, widths.get(c, 12), " "))
    return df.select(F.rtrim(F.concat(*cells)).alias("line"))
