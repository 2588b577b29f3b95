"""URL filtering by mined association rules.

Combinations of URL tokens that go with a block label are mined level by level: hosts and their suffixes, path segments, query parts
and the words within all of them. Each level extends the sets that enough blocked URLs hold by one more token of the same URL and
counts them on all labelled URLs, so none is missed that has the support. Rules are pruned by support, by the lower bound of their
confidence and by simpler rules that are no less confident, and matched by an inverted index: each rule hangs on its rarest token, pages'
URLs meet it there and the rest of its tokens are verified. A short list of stated (host, path) rules takes precedence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded, stage

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts so; the longest wins.
STATED_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Least share and number of labelled rows that a rule's tokens are on, its least confidence, and the least value of the lower end of
#: its confidence's 95 % interval (Wilson's).
MIN_SUPPORT = 0.0002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.8
MIN_LOWER = 0.6
#: Tokens of a rule.
MAX_TOKENS = 3
BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? # (A-Z lower-cased); empty for null or where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-z]+"), lambda w: F.length(w) >= 2)


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, every suffix of the host, path segments with their place, file ending, query keys and
    pairs, and the words within each. Numbers within the path count as '#', as no rule should hang on one page's number."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(F.regexp_replace(path, r"\d+", "#"), "/"), lambda p: p != "")
    segments = F.transform(parts, lambda p, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), p))
    ending = F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)), lambda x: x != "")
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    query = F.filter(F.split(asked, "&"), lambda p: p != "")
    pairs = F.flatten(F.transform(query, lambda p: F.array(F.concat(F.lit("query:"), p), F.concat(F.lit("key:"), F.substring_index(p, "=", 1)))))
    scheme = F.filter(F.array(F.lower(F.regexp_extract(url, "^([^:/?#]*)://", 1))), lambda x: x != "")

    def named(kind: str, x: Column) -> Column:
        return F.transform(x, lambda t: F.concat(F.lit(kind), t))

    words = named("hostword:", _words(host)), named("pathword:", _words(path)), named("queryword:", _words(asked))
    return F.array_distinct(F.concat(named("scheme:", scheme), suffixes, segments, named("ending:", ending), pairs, *words))


def frequent_tokens(rows: DataFrame, least: int) -> DataFrame:
    """(token, n) of the tokens that at least so many blocked ones of rows (basket, tokens, blocked) have; n counts all rows. Of tokens
    that lie on the same rows, as a host and its words do, the shortest is enough."""
    each = rows.select("basket", "blocked", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("k"), F.bit_xor(F.xxhash64("basket")).alias("rows"))
    alike = counts.where(F.col("k") >= least).groupBy("n", "k", "rows").agg(F.min(F.struct(F.length("token"), "token"))["token"].alias("token"))
    return stage(alike.select("token", "n"), "tokens")


def count_sets(rows: DataFrame, told: DataFrame, least: int, max_tokens: int) -> DataFrame:
    """(tokens, n, hit): on how many rows (basket, tokens, blocked) each set of at most max_tokens of told's tokens is whole, and how many
    of these are blocked, of all sets with at least so many; the rarest token comes first.

    A set all of whose rows are blocked isn't extended: a larger one is on no more rows, and no more confident.
    """
    each = rows.select("basket", "blocked", F.explode("tokens").alias("token")).join(bounded(told, BROADCAST_ROWS), "token")
    items = each.groupBy("basket", "blocked").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("items"))
    items = stage(items.select("blocked", F.transform("items", lambda x: x["token"]).alias("items")), "baskets")
    held = items.select("blocked", "items", F.lit(-1).alias("at"), F.array().cast("array<string>").alias("tokens"))
    found = None
    for _ in range(max_tokens):
        more = held.where(F.col("at") + 1 < F.size("items")).withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.size("items") - 1)))
        more = more.withColumn("tokens", F.concat("tokens", F.array(F.get("items", F.col("at")))))
        counts = more.groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("hit"))
        counts = stage(counts.where(F.col("hit") >= least), "sets")
        found = counts if found is None else found.union(counts)
        open_sets = counts.where("hit < n").select("tokens")
        if open_sets.isEmpty():
            break
        held = more.join(bounded(open_sets, BROADCAST_ROWS), "tokens", "left_semi").select("blocked", "items", "at", "tokens")
    return found


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, min_lower: float = MIN_LOWER
) -> DataFrame | None:
    """Rules (tokens, at_token, confidence, support) from labelled rows (url, blocked boolean); None if there are none.

    Rows without a url or a label are left out, repeated rows count each. See mine_baskets.
    """
    rows = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select(url_tokens(F.col("url")).alias("tokens"), "blocked")
    return mine_baskets(rows, min_support, min_count, min_confidence, max_tokens, min_lower)


def mine_baskets(rows: DataFrame, min_support: float, min_count: int, min_confidence: float, max_tokens: int, min_lower: float) -> DataFrame | None:
    """Rules from rows (tokens array<string>, blocked boolean): of at most max_tokens tokens, on enough rows, of confidence
    min_confidence at least and a lower bound of it above min_lower.

    at_token is the rarest of a rule's tokens, the first of ties. Rules whose tokens include those of another, no less confident one
    are dropped.
    """
    rows = stage(rows.withColumn("basket", F.monotonically_increasing_id()), "labelled")
    total = rows.count()
    least = max(min_count, int(-(-min_support * total // 1)))
    if total < least:
        return None
    sets = count_sets(rows, frequent_tokens(rows, least), least, max_tokens)
    rules = sets.withColumns({"at_token": F.get("tokens", F.lit(0)), "tokens": F.sort_array("tokens"), "confidence": F.col("hit") / F.col("n")})
    z, p, n = 1.96, F.col("confidence"), F.col("n")
    lower = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rules = stage(rules.where((p >= min_confidence) & (lower > min_lower)).select("tokens", "at_token", "confidence", (F.col("hit") / total).alias("support")), "rules")
    if rules.isEmpty():
        return None
    # a simpler rule is a strict subset of tokens: each rule asks for its own subsets, at most 2 ** max_tokens
    subsets = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("tokens", subsets, lambda have, t: F.concat(have, F.transform(have, lambda x: F.concat(x, F.array(t)))))
    smaller = rules.select("tokens", "confidence", F.explode(subsets).alias("sub")).where("size(sub) < size(tokens)")
    known = rules.select(F.col("tokens").alias("sub"), F.col("confidence").alias("sub_confidence"))
    beaten = smaller.join(known, "sub").where("sub_confidence >= confidence").select("tokens").distinct()
    return stage(rules.join(beaten, "tokens", "left_anti"), "rules")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct urls that some rule fits, with the best rule's confidence. Null urls fit none."""
    have = urls.select("url").distinct().select("url", url_tokens(F.col("url")).alias("have"))
    met = have.select("url", "have", F.explode("have").alias("at_token")).join(bounded(rules, BROADCAST_ROWS), "at_token")
    return met.where(F.size(F.array_except("tokens", "have")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = STATED_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = STATED_RULES) -> DataFrame:
    """One row for every row of pages: id_col, host, path, rule and verdict ('allow' or 'block').

    A null url, or one without ://, has an empty host and path and no stated rule; a null url is allowed. Without labels, or where no
    rule is mined, what no stated rule fits is allowed. Repeated rows are judged each; other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    mined = mine_rules(labelled)
    judged = rows.withColumn("confidence", F.lit(None).cast("double")) if mined is None else rows.join(match_rules(rows, mined), "url", "left")
    split = judged.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), "confidence")
    rule, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return split.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def page_labels(pages: DataFrame, labels: DataFrame, seeds: Sequence[str] = ()) -> DataFrame:
    """(url, blocked): pages whose host has one of the seed words that a caller gives are blocked; others are if their url names a document (/lang/NUMBER) that is
    labelled, and labelled of low quality or toxic. Other pages, as those with a null
    url, have no label and no row; of repeated labels the worst counts, and repeated pages count each."""
    numbered = pages.select("url", F.regexp_extract("url", r"://[^/?#]*/[^/?#]+/(\d{1,18})", 1).try_cast("long").alias("doc_id"))
    said = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    seeded = F.arrays_overlap(_words(host_of(F.col("url"))), F.array(*map(F.lit, seeds)).cast("array<string>"))
    named = numbered.where(seeded).select("url", F.lit(True).alias("blocked"))
    other = numbered.where(~F.coalesce(seeded, F.lit(False))).join(said, "doc_id").select("url", (F.col("bad") == 1).alias("blocked"))
    return named.unionAll(other)
