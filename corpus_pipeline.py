"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, extra ones too. Null and empty texts pass through the first four
(near-duplicates keep one of them, as they are copies of each other) and pack as their end id; rows without an id stay; an empty table
gives no rows. Of rows that repeat an id near-dedup keeps one, the least as JSON where they differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.common import stage
from siftwell.llm.decontaminate import drop_contaminated
from siftwell.llm.packing import pack_documents
from siftwell.llm.pii import redact
from siftwell.llm.simhash_dedup import drop_loose_duplicates
from siftwell.llm.toxicity import drop_toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the table of labels, doesn't find toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies, five-word similarity of about 0.8 or more."""
    return drop_loose_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", redact_pii),
    ("packing", pack),
]

#: SimHash, the classifiers and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
