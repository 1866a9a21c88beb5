"""Lexical and vector retrieval, fusion and ranking.

A document's term counts are folded within its row (a sort and the gaps between
the places where the term changes), so only terms are shuffled, with map-side
sums.  A query's terms are few and given, so they filter a row's terms before
anything else; top-k is TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text
from sparkloom.sources.shared import written


def _folded(d: DataFrame, key: str) -> DataFrame:
    """(key, length, counts) from (key, length, terms): counts is an array of (term, tf) in the order of terms."""
    d = d.withColumn("terms", F.sort_array("terms"))
    at = F.sequence(F.lit(0), F.size("terms") - 1)
    d = d.withColumn("starts", F.when(F.size("terms") > 0, F.filter(at, lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))).otherwise(F.array().cast("array<int>")))
    entry = lambda i, k: F.struct(F.get("terms", i).alias("term"), (F.coalesce(F.get("starts", k + 1), F.size("terms")) - i).cast("long").alias("tf"))
    return d.select(key, "length", F.transform("starts", entry).alias("counts"))


def term_frequencies(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, term, tf, length): a row for each term of each document; length counts all its terms.  Row-local."""
    t = docs.select(key, text.tokens(F.col(content)).alias("terms")).withColumn("length", F.size("terms"))
    # Not explode: Spark would infer a filter on the array's size and work out all of it once more, element by element.
    return _folded(t, key).select(key, "length", F.explode_outer("counts").alias("c")).where("c IS NOT NULL").select(key, "length", "c.term", "c.tf")


def corpus_stats(docs: DataFrame, content: str) -> DataFrame:
    """One row: n_docs and avg_length in terms."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(text.tokens(F.col(content))).cast("double")).alias("avg_length"))


def term_stats(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def weighted_terms(tf: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """tf with its BM25 weight.  stats is one row, by construction."""
    j = tf.join(terms, "term").join(F.broadcast(stats), F.lit(True))
    return j.withColumn("weight", scoring.bm25_weight(scoring.idf(F.col("n_docs"), F.col("df")), F.col("tf"), F.col("length"), F.col("avg_length")))


def bm25(docs: DataFrame, key: str, content: str, terms: list[str]) -> DataFrame:
    """(key, score) of the documents that hold any of the query's terms (distinct, at most a few hundred).

    One pass over the texts leaves slim rows (key, length, counts of the query's
    terms), which are written; statistics and scores come from those.
    """
    wanted = F.array(*[F.lit(t) for t in sorted(set(terms))]) if terms else F.array().cast("array<string>")
    d = docs.select(key, text.tokens(F.col(content)).alias("terms")).withColumn("length", F.size("terms"))
    slim = written(_folded(d.withColumn("terms", F.filter("terms", lambda x: F.array_contains(wanted, x))), key), "postings")
    tf = slim.select(key, "length", F.explode("counts").alias("c")).select(key, "length", "c.term", "c.tf")
    stats = slim.agg(F.count("*").alias("n_docs"), F.avg(F.col("length").cast("double")).alias("avg_length"))
    # A query's terms are a few hundred rows at most, and so are their statistics.
    weighted = tf.join(F.broadcast(term_stats(tf)), "term").join(F.broadcast(stats), F.lit(True))
    weight = scoring.bm25_weight(scoring.idf(F.col("n_docs"), F.col("df")), F.col("tf"), F.col("length"), F.col("avg_length"))
    return weighted.groupBy(key).agg(F.round(F.sum(weight), 6).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best, ties by key."""
    return scored.orderBy(F.desc(score), key).limit(k)


def top_per(scored: DataFrame, group: str, k: int, score: str, key: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each query (query_id, query): exact, for a stated query set that is broadcast."""
    scored = vectors.join(F.broadcast(queries), F.lit(True)).select("query_id", key, F.round(scoring.cosine(F.col(vector), F.col("query")), 6).alias("score"))
    return top_per(scored, "query_id", k, "score", key)


def cosine_blocks(vectors: DataFrame, queries: DataFrame, k: int, n_queries: int, n_vectors: int, per: int = 256, most: int = 4096, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each query (query_id, query), for query sets of any size: exact.

    Blocks of about per queries meet blocks of about most vectors, dealt by a
    hash of the ids; each pair of blocks is one matrix product that keeps its
    own k for each query, and those few are ranked.  Null vectors take no part.
    """
    import numpy as np
    import pandas as pd

    nq, nv = -(-max(n_queries, 1) // per), -(-max(n_vectors, 1) // most)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.where("query IS NOT NULL").select("query_id", F.col("query").cast("array<double>").alias("x"), block("query_id", nq).alias("qb")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("x"), block(key, nv).alias("vb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    kind = dict(vectors.dtypes)[key]

    def unit(x) -> np.ndarray:
        m = np.stack([np.asarray(r, "float64") for r in x])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "_key": [], "score": []})
        b = b.sort_values("_key", kind="stable")
        scores = (unit(a.x) @ unit(b.x).T).round(6)
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(a.query_id.to_numpy(), at.shape[1]), "_key": b["_key"].to_numpy()[at].ravel(), "score": np.take_along_axis(scores, at, 1).ravel()})

    few = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(best, f"query_id {dict(queries.dtypes)['query_id']}, _key {kind}, score double")
    return top_per(few.withColumnRenamed("_key", key), "query_id", k, "score", key)


def fused(dense: DataFrame, sparse: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two short lists (key, score, ...); the payload comes from dense where both have it.  The lists are the callers' top results, so one window ranks each."""
    ranked = lambda d, n: d.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("score"), key))).select(key, scoring.rrf(F.col("_rank")).alias("_rrf"), F.lit(n).alias("_from"))
    both = ranked(dense, 0).unionByName(ranked(sparse, 1))
    out = both.groupBy(key).agg(F.round(F.sum("_rrf"), 6).alias("rrf"), F.min("_from").alias("source"))
    return out.withColumn("source", F.when(F.col("source") == 0, "dense").otherwise("sparse")).orderBy(F.desc("rrf"), key).limit(k)


def ranked(candidates: DataFrame, similarity: str, graph: str, meta: str, key: str, weights=(0.6, 0.25, 0.15)) -> DataFrame:
    return candidates.withColumn("final_score", F.round(scoring.weighted(F.col(similarity), F.col(graph), F.col(meta), weights), 6)).orderBy(F.desc("final_score"), key)


def cross_project(results: list[DataFrame], allowed: list[str], k: int, key: str) -> DataFrame:
    """One list from several projects' (project_id, key, score), those that are allowed (* allows all), best first."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    if "*" not in allowed:
        out = out.where(F.col("project_id").isin(*allowed))
    return out.orderBy(F.desc("score"), key).limit(k)
