"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import conversation_repair, decontaminate, host_rules, html_extract, language_id, lexical_search, packing, pii, preference_format, simhash_dedup, token_files, toxicity, url_rules

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format.render_pairs(preference_format.swapped_answers(_table(spark, sf_dir, "conversations")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_rules.judge_urls(pages, url_rules.page_labels(pages, _table(spark, sf_dir, "labels")))


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality_verdicts(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(_table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_decontamination,
        op3_toxicity,
        op4_preference_formatting,
        op5_token_files,
        op6_packing,
        op7_url_rules,
        op8_host_quality,
        op9_pii,
        op10_html_extraction,
        op11_conversation_repair,
        op12_language_id,
        op13_lexical_search,
    )
}
#: SQL for DuckDB where it can express the whole query.
ORACLES: dict[str, str] = {
    "op4_preference_formatting": preference_format.ORACLE_SQL,
    "op8_host_quality": host_rules.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
