"""Run settings, with the defaults of the entry points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Defaults.
@dataclass(frozen=True)
class Settings:
    seed: int = 42
    n_virl: int = 4000
    n_pope_style: int = 1600
    n_tally: int = 900
    n_synthetic: int = 1500
    max_hamming: int = 5
    cosine_threshold: float = 0.95
    acc_cf_threshold: float = 0.80
    prior_rate_threshold: float = 0.30
    kl_ce_band: tuple[float, float] = (0.3, 0.7)
    beta: float = 0.1
    skip: tuple[str, ...] = field(default=())


def read_settings(text: str) -> Settings:
    """Settings from flat 'key: value' lines; unknown keys raise, comments and blank lines don't count."""
    known = {f.name: f for f in fields(Settings)}
    values: dict = {}
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line:
            key, _, value = (x.strip() for x in line.partition(":"))
            if key not in known:
                raise KeyError(f"{key} is none of {sorted(known)}")
            default = known[key].default
            if isinstance(default, int):
                values[key] = int(value)
            elif isinstance(default, float):
                values[key] = float(value)
            else:
                parts = [p.strip() for p in value.strip("[]() ").split(",") if p.strip()]
                values[key] = tuple(float(p) for p in parts) if key == "kl_ce_band" else tuple(parts)
    return Settings(**values)


#: A row of settings.
COLUMNS = "seed bigint, n_virl bigint, n_pope_style bigint, n_tally bigint, n_synthetic bigint, max_hamming bigint, cosine_threshold double, acc_cf_threshold double, prior_rate_threshold double, kl_ce_band array<double>, beta double, skip array<string>"


def settings_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, settings...) of the settings files that a path names, a run's each; what a file doesn't set has its default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"file": f} | asdict(read_settings(text)) for f, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            names = ["file", *(c.name for c in fields(Settings))]
            kinds = {"skip": pa.list_(pa.string()), "kl_ce_band": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n)) for n in names], names=names)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInArrow(run, f"file string, {COLUMNS}")
