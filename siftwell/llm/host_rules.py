"""Document quality rules with a verdict by host, in DataFrame functions only.

Per document the base counts; per host (the ``source`` column) the failures of each rule; the hosts' failure rates, shrunk
towards a beta prior that is estimated from all hosts. A host is rejected where, for some rule, its failure rate is all but surely
(a posterior chance of about 95 %) above FACTOR times that of all documents and above FLOOR. The verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import stage, words_of

#: A host goes when its failure rate of a rule is this many times that of all documents, and this high, ...
FACTOR = 2.0
FLOOR = 0.2
#: ... with so many posterior standard deviations to spare (95 % of a normal distribution lie above the mean less these).
SURE = 1.645
WINDOW = 8
MAX_PRIOR = 1e6


def _rules() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < 20,
        "repetitive": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": F.col("n_symbols") > F.lit(0.2) * F.col("word_chars"),
        "lines": F.lit(10) * F.col("n_dup_lines") > F.col("n_words"),
    }


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id_col, host and the base counts of each row; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select(
        F.col(id_col),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        words_of(F.col(text_col)).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    hashed = cut.select(
        id_col,
        "host",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # several uses of h (and below of win and sorted) keep each from being merged into the lambda that reads it
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    kept = [id_col, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    win = hashed.select(*kept, F.when(F.size("h") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("win"))
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    ordered = F.when(repeats, F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("at")))))
    by_value = win.select(*kept, ordered.alias("sorted"))
    twice = F.filter("sorted", lambda s, j: (F.get("sorted", j + 1)["x"] == s["x"]) | ((j > 0) & (F.get("sorted", F.greatest(j - 1, F.lit(0)))["x"] == s["x"])))
    starts = F.sort_array(F.transform(twice, lambda s: s["at"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n")),
        lambda a: a["n"],
    )
    return by_value.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, factor: float = FACTOR, floor: float = FLOOR, sure: float = SURE) -> DataFrame:
    """(host, rejected) from measured rows: empirical-Bayes shrinkage of each rule's failure rate.

    The prior's mean is the rate over all documents; its strength comes from the spread of the hosts' rates beyond what
    sampling explains. Where they don't spread, every host is shrunk to the mean. Of the beta posterior its mean less sure standard
    deviations is compared.
    """
    rules = _rules()
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(rule.cast("long")).alias(name) for name, rule in rules.items()])
    totals = hosts.agg(F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in rules]).first()
    if not totals["n"]:
        return hosts.select("host", F.lit(False).alias("rejected"))
    mean = {name: totals[name] / totals["n"] for name in rules}
    spread = hosts.agg(
        *[(F.avg(F.pow(F.col(name) / F.col("n") - mean[name], 2)) - F.avg(F.lit(mean[name] * (1 - mean[name])) / F.col("n"))).alias(name) for name in rules]
    ).first()
    rejected = F.lit(False)
    for name in rules:
        m, v = mean[name], spread[name]
        strength = min(MAX_PRIOR, max(1.0, m * (1 - m) / v - 1)) if v > 0 else MAX_PRIOR
        rate = (F.col(name) + m * strength) / (F.col("n") + strength)
        spare = sure * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
        rejected = rejected | (rate - spare > max(factor * m, floor))
    return hosts.select("host", rejected.alias("rejected"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", factor: float = FACTOR, floor: float = FLOOR) -> DataFrame:
    """One row for every row of docs: id_col, the base counts, base_failed and kept.

    Null and blank texts have no words and fail; null hosts are one host; repeated rows count and are returned each; an empty
    table gives no rows; other columns are ignored.
    """
    measured = stage(base_counts(docs, id_col, text_col, host_col), "quality")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.join(host_verdicts(measured, factor, floor), "host", "left")
    return judged.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
    )


#: Fixed rates of the same rules and prior, for DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, list_aggregate(w[i:i+7], 'string_agg', ' ') AS s FROM w, unnest(generate_series(1, len(w) - 7)) AS g(i)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(generate_series(0, 7)) AS g(k) GROUP BY r),
m AS (
  SELECT d.doc_id, d.host, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT host, rule, count(*) AS n, sum(CAST(bad AS BIGINT)) AS k FROM (
  SELECT host, 'short' AS rule, n_words < 20 AS bad FROM m UNION ALL
  SELECT host, 'repetitive', 100 * n_repeat_words > 30 * n_words FROM m UNION ALL
  SELECT host, 'symbols', n_symbols > 0.2 * word_chars FROM m UNION ALL
  SELECT host, 'lines', 10 * n_dup_lines > n_words FROM m) GROUP BY ALL),
mean AS (SELECT rule, sum(k) / sum(n) AS mu FROM f GROUP BY rule),
prior AS (SELECT rule, mu, avg(pow(k / n - mu, 2)) - avg(mu * (1 - mu) / n) AS v FROM f JOIN mean USING (rule) GROUP BY rule, mu),
s AS (SELECT rule, mu, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, mu * (1 - mu) / v - 1)) ELSE 1e6 END AS strength FROM prior),
post AS (SELECT host, rule, mu, n + strength AS weight, (k + mu * strength) / (n + strength) AS rate FROM f JOIN s USING (rule)),
verdict AS (SELECT host, bool_or(rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > greatest(2.0 * mu, 0.2)) AS rejected FROM post GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT rejected AS kept
FROM m JOIN verdict USING (host)
"""
