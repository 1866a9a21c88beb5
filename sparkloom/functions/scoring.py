"""Scores: cosine, BM25, weighted ranks, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import rules

K1, B = 1.2, 0.75
RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25_weight(idf: Column, tf: Column, length: Column, avg_length: Column) -> Column:
    return F.greatest(F.lit(0.0), idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / avg_length)))


def bm25_query_weight(idf: Column, tf: Column, avg_length: Column) -> Column:
    """The denominator has b times the mean length, undivided: kept for parity; ranking uses the documents' weights alone."""
    return F.greatest(F.lit(0.0), idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * avg_length)))


def rrf(rank: Column) -> Column:
    """Of a rank from 1."""
    return F.lit(1.0) / (F.lit(float(RRF_K)) + rank)


def weighted(similarity: Column, graph: Column, meta: Column, weights: tuple[float, float, float] = (0.6, 0.25, 0.15)) -> Column:
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError(f"weights must sum to 1, not {sum(weights)}")
    a, b, c = weights
    return F.lit(a) * similarity + F.lit(b) * graph + F.lit(c) * meta


def price(provider: Column, model: Column) -> Column:
    """Dollars a million tokens by the first rule that fits; null for others."""
    out = F.lit(None).cast("double")
    for who, part, dollars in reversed(rules.PRICES):
        out = F.when((provider == who) & model.contains(part), dollars).otherwise(out)
    return out
