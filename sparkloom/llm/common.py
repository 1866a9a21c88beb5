"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import shared_dir, written  # noqa: F401  (the operators take them from here)

#: ASCII letters, for the lower-casing of A-Z alone that the contracts ask for.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often the body names it.

    Inside a lambda an expression is evaluated again at each step, unless it is
    itself a lambda variable; the one-element array makes it one.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: Bits of the map of ids that ``maybe`` broadcasts: sixteen an id, within these bounds (as powers of two); at most 2**21 rows of two longs.
MAP_BITS = (20, 27)


def maybe(df: DataFrame, key: str, ids: DataFrame, flag: str, n_ids: int) -> DataFrame:
    """df with a column flag: false only where key is none of ids (one column, named key; about n_ids of them).

    A one-hash Bloom filter, made by an aggregate of bits into words and joined
    by broadcast.  With more ids than the largest map can tell apart it lets more
    through and stays right; it spares the rows it excludes a shuffle.
    """
    bits = min(max((16 * n_ids).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    place, word, found = fresh(df, "place", "word", "found")
    bit = lambda c: F.xxhash64(c).bitwiseAND((1 << bits) - 1)
    at = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` & 63 as int))")
    words = ids.where(F.col(key).isNotNull()).select(bit(F.col(key)).alias(place)).groupBy(F.shiftright(place, 6).alias(word)).agg(F.bit_or(at(place)).alias(found))
    d = df.withColumn(place, bit(F.col(key))).withColumn(word, F.shiftright(place, 6)).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.col(found).bitwiseAND(at(place)) != 0, F.lit(False)) & F.col(key).isNotNull()
    return d.withColumn(flag, hit).select(*df.columns, flag)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is none of ids (distinct, written); only those that may be are shuffled for an exact test."""
    (flag,) = fresh(df, "maybe")
    marked = maybe(df, key, ids, flag, ids.count())
    return marked.where(~F.col(flag)).drop(flag).unionByName(marked.where(flag).drop(flag).join(ids.hint("merge"), key, "left_anti"))
