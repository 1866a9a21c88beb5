"""Retrieval queries on documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text
from sparkloom.operators import retrieval as R
from sparkloom.plans.base import query
from sparkloom.sources.tables import table

#: The tokens of documents, for DuckDB.
TOKENS = r"list_transform(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: strlen(x) > 1), lambda x: lower(x))"
_TF = f"""d AS (SELECT doc_id, {TOKENS} AS terms FROM documents),
x AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM x GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(terms)::DOUBLE) AS a FROM d)"""
_IDF = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE)"
_W = f"greatest(0.0::DOUBLE, {_IDF} * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / a)))"
_Q = f"q AS (SELECT DISTINCT unnest({TOKENS}) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))"
_BM25 = f"b AS (SELECT doc_id, round(sum({_W}), 6) AS score FROM tf JOIN df USING (term), st WHERE term IN (SELECT term FROM q) GROUP BY 1)"
_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def query_terms(spark: SparkSession, sf_dir: str) -> list[str]:
    """The terms of the first benchmark text: the query, a driver-side value."""
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(text.tokens(F.col("text")).alias("t")).first()
    return sorted(set(first["t"])) if first else []


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", query_terms(spark, sf_dir))


@query("bm25_topk", f"WITH {_TF}, {_Q}, {_BM25} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(bm25_scores(spark, sf_dir), 10)


@query("bm25_corpus_stats", f"WITH {_TF} SELECT n AS n_docs, round(a, 6) AS avg_length, (SELECT count(*) FROM df) AS n_terms FROM st")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = R.term_stats(R.term_frequencies(docs, "doc_id", "text")).agg(F.count("*").alias("n_terms"))
    return R.corpus_stats(docs, "text").join(F.broadcast(n), F.lit(True)).withColumn("avg_length", F.round("avg_length", 6))


@query("bm25_term_stats", f"WITH {_TF} SELECT term, df, round({_IDF}, 6) AS idf FROM df, st")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    t = R.term_stats(R.term_frequencies(docs, "doc_id", "text")).join(F.broadcast(R.corpus_stats(docs, "text")), F.lit(True))
    return t.select("term", "df", F.round(scoring.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query("bm25_doc_weights", f"WITH {_TF} SELECT doc_id, term, tf, round({_W}, 6) AS weight FROM tf JOIN df USING (term), st")
def bm25_doc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tf = R.term_frequencies(docs, "doc_id", "text")
    return R.weighted_terms(tf, R.term_stats(tf), R.corpus_stats(docs, "text")).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query(
    "bm25_query_weights",
    f"""WITH {_TF}, bq AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark), bt AS (SELECT item_id, term, count(*) AS tf FROM bq GROUP BY ALL)
SELECT item_id, term, round(greatest(0.0::DOUBLE, {_IDF} * bt.tf * 2.2::DOUBLE / (bt.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * a))), 6) AS weight FROM bt JOIN df USING (term), st""",
)
def bm25_query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    q = R.term_frequencies(table(spark, sf_dir, "benchmark"), "item_id", "text")
    j = q.join(R.term_stats(R.term_frequencies(docs, "doc_id", "text")), "term").join(F.broadcast(R.corpus_stats(docs, "text")), F.lit(True))
    return j.select("item_id", "term", F.round(scoring.bm25_query_weight(scoring.idf(F.col("n_docs"), F.col("df")), F.col("tf"), F.col("avg_length")), 6).alias("weight"))


@query(
    "cosine_topk",
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank::INT AS rank FROM r WHERE rank <= 10""",
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all, in blocks."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.cosine_blocks(v, q, 10, q.count(), v.count())


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with vector 0, as (doc_id, score)."""
    v = table(spark, sf_dir, "embeddings")
    return v.join(F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("query"))), F.lit(True)).select(F.col("vec_id").alias("doc_id"), F.round(scoring.cosine(F.col("embedding"), F.col("query")), 6).alias("score"))


_DENSE = f"de AS (SELECT e.vec_id AS doc_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query("filtered_search", f"WITH {_DENSE} SELECT doc_id, score FROM de JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 10")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return R.top(_dense(spark, sf_dir).join(docs, "doc_id"), 10)


@query(
    "hybrid_rrf",
    f"""WITH {_TF}, {_Q}, {_BM25}, {_DENSE},
dt AS (SELECT * FROM de ORDER BY score DESC, doc_id LIMIT 20), sp AS (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 20),
r AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS r, 0 AS f FROM dt
UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 1 FROM sp)
SELECT doc_id, round(sum(r), 6) AS rrf, CASE min(f) WHEN 0 THEN 'dense' ELSE 'sparse' END AS source FROM r GROUP BY 1 ORDER BY rrf DESC, doc_id LIMIT 10""",
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: dense and lexical search, twice the wanted results from each, fused."""
    return R.fused(R.top(_dense(spark, sf_dir), 20), R.top(bm25_scores(spark, sf_dir), 20), 10)


_RANK = f"""{_DENSE}, g AS (SELECT source, count(*) / 100.0::DOUBLE AS graph FROM documents GROUP BY 1),
rk AS (SELECT doc_id, source, round(0.6::DOUBLE * score + 0.25::DOUBLE * graph + 0.15::DOUBLE * (n_chars % 100) / 100, 6) AS final_score
FROM de JOIN documents USING (doc_id) JOIN g USING (source))"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    degree = docs.groupBy("source").agg((F.count("*") / 100.0).alias("graph"))
    c = _dense(spark, sf_dir).join(docs, "doc_id").join(degree, "source").withColumn("meta", F.col("n_chars") % 100 / F.lit(100.0))
    return R.ranked(c, "score", "graph", "meta", "doc_id").select("doc_id", "source", "final_score")


@query("weighted_rank", f"WITH {_RANK} SELECT doc_id, source, final_score FROM rk")
def weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir)


@query("cross_project_rank", f"WITH {_RANK} SELECT source AS project_id, doc_id, final_score AS score FROM rk WHERE source IN ('src0', 'src1', 'src2') ORDER BY score DESC, doc_id LIMIT 10")
def cross_project_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four projects' lists, of which three may be seen."""
    w = _weighted(spark, sf_dir).select(F.col("source").alias("project_id"), "doc_id", F.col("final_score").alias("score"))
    return R.cross_project([w.where(F.col("project_id") == f"src{k}") for k in range(4)], ["src0", "src1", "src2"], 10, "doc_id")
