"""Shared fixtures of the queries: SQL that both Spark and DuckDB run over the test tables, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Evaluation records: three models' answers by modular arithmetic over documents.
REC = """
SELECT doc_id, CAST(doc_id AS STRING) AS sample_id,
  CASE doc_id % 4 WHEN 2 THEN 'pope_adversarial' WHEN 3 THEN 'mathvista_mini' ELSE 'vlmbias_main' END AS dataset,
  lang AS topic, source, n_chars,
  CASE WHEN doc_id % 17 = 0 THEN 'boom' WHEN doc_id % 19 = 0 THEN '' END AS error,
  doc_id % 3 <> 0 AS correct_i, doc_id % 5 = 0 AS correct_null,
  (n_chars % 97) / 97.0E0 AS mean_delta,
  CAST(doc_id % 5 AS STRING) AS gold, CAST(doc_id * 7 % 5 AS STRING) AS answer,
  doc_id * 7 % 5 = doc_id % 5 AS correct,
  CASE WHEN doc_id % 23 = 0 THEN '' ELSE CAST(doc_id * 11 % 5 AS STRING) END AS s_answer, doc_id * 11 % 5 = doc_id % 5 AS s_correct,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id * 3 % 5 AS STRING) ELSE CAST(doc_id * 7 % 5 AS STRING) END AS b_answer,
  CASE WHEN doc_id % 2 = 0 THEN doc_id * 3 % 5 ELSE doc_id * 7 % 5 END = doc_id % 5 AS b_correct,
  (doc_id % 13) / 13.0E0 AS gt_i, (doc_id % 6) / 6.0E0 AS gt_null,
  CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 11) / 11.0E0 END AS bias_i, (doc_id % 9) / 9.0E0 AS bias_null,
  doc_id % 2 = 0 AS is_counterfactual, CAST(doc_id * 2 % 5 AS STRING) AS prior
FROM documents
"""

#: A training log, a step a line, some steps logged twice.
LOG = """
SELECT event_id AS line_no, 'x training/global_step: ' || CAST(event_id % 200 AS STRING) || ' actor/loss=' || CAST(event_id % 50 AS STRING)
  || '.5 perf/x=' || CAST(event_id % 7 AS STRING) || 'e-1 foo=True other/y=3 actor/grad_norm=' ||
  CASE WHEN event_id % 11 = 0 THEN 'nan' ELSE CAST(event_id % 13 AS STRING) END AS line
FROM events
"""

#: The same log's finite values.
SERIES = """
SELECT event_id % 200 AS step, event_id AS line_no, 'actor/loss' AS metric, event_id % 50 + 0.5E0 AS value FROM events
UNION ALL SELECT event_id % 200, event_id, 'perf/x', (event_id % 7) / 10.0E0 FROM events
UNION ALL SELECT event_id % 200, event_id, 'actor/grad_norm', CAST(event_id % 13 AS DOUBLE) FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT event_id % 200, event_id, 'training/global_step', CAST(event_id % 200 AS DOUBLE) FROM events
"""

#: Token rows of a loss: line items as tokens, orders as samples.
TOK = """
SELECT l_orderkey AS sample_id, l_orderkey % 50 AS batch_id, l_linenumber AS t, l_linenumber % 4 <> 0 AS mask,
  CAST(l_quantity AS DOUBLE) AS raw_kl, -l_discount * 10 AS log_prob, l_tax * 100 AS delta,
  CASE l_orderkey % 3 WHEN 0 THEN 'ce' WHEN 1 THEN 'kl' END AS loss_branch,
  CASE l_orderkey % 4 WHEN 0 THEN 'virl' WHEN 1 THEN 'pope' WHEN 2 THEN 'tally' END AS bucket,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_orderkey % 2 = 0 END AS trajectory_pass,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE 0.2E0 END AS beta
FROM lineitem
"""

#: Images and their categories: orders and the brands in them.
ANN = """
SELECT DISTINCT l_orderkey AS image_id, p_brand AS cat FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the test tables, named plainly."""
    import re

    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of the SQL's own
    for t in used:
        sql = re.sub(rf"\b{t}\b", f"{{{t}}}", sql)
    return spark.sql(sql, **frames)


def query(name: str, oracle: str | None = None, **ctes: str) -> Callable:
    """Register a query; oracle is DuckDB SQL, with the named fixtures in front of it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle is not None:
            front = ", ".join(f"{k} AS ({v})" for k, v in ctes.items())
            ORACLES[name] = f"WITH {front} {oracle}" if front else oracle
        return f

    return put
