"""Array and map functions on columns: token series, top-K distributions, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Null for a null or empty array; NaN propagates."""
    return F.try_divide(total(a), F.size(a))


def first_argmax(a: Column) -> Column:
    """0-based place of the first maximum."""
    return F.array_position(a, F.array_max(a)) - 1


def pad(a: Column, width: int) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), width)), 1, width)


def response_slice(a: Column, prompt_len: Column, length: Column) -> Column:
    """[p - 1, p - 1 + length) of a 0-based series."""
    return F.slice(a, prompt_len, length)


def trim_to(a: Column, b: Column) -> Column:
    return F.slice(a, 1, F.least(F.size(a), F.size(b)))


def zipped(a: Column, b: Column) -> Column:
    """Pairs up to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def normalized(a: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def get_or(m: Column, key: Column | str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key) if isinstance(key, str) else key), default)


def _kl(p: Column, q: Column, support: Column) -> Column:
    """KL of two log-prob maps over a support; a side's missing keys get its least log-prob, both sides are renormalized."""

    def probs(m: Column) -> Column:
        floor = F.array_min(F.map_values(m))
        return F.transform(support, lambda k: F.exp(F.coalesce(F.try_element_at(m, k), floor)))

    pp, qq = probs(p), probs(q)
    ps, qs = total(pp), total(qq)
    terms = F.zip_with(pp, qq, lambda x, y: F.when(x > 0, x / ps * (F.ln(x / ps) - F.ln(y / qs))).otherwise(0.0))
    return F.when((ps > 0) & (qs > 0), total(terms)).otherwise(0.0)


def kl_union(p: Column, q: Column) -> Column:
    """KL over the union of both supports."""
    return _kl(p, q, F.array_union(F.map_keys(p), F.map_keys(q)))


def kl_teacher_support(p: Column, q: Column) -> Column:
    """KL over the first distribution's support alone."""
    return _kl(p, q, F.map_keys(p))


def log_softmax_at(logits: Column, at: Column) -> Column:
    """log softmax of an array, taken at a 0-based place."""
    top = F.array_max(logits)
    return F.get(logits, at) - top - F.ln(total(F.transform(logits, lambda x: F.exp(x - top))))


def top_k(a: Column, k: int) -> Column:
    return F.slice(F.sort_array(a, asc=False), 1, k)


def not_in(ranked: Column, have: Column) -> Column:
    """What of a ranked array is not in another; order and repeats stay."""
    return F.filter(ranked, lambda c: ~F.array_contains(have, c))
