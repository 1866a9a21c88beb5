"""Chunks, text functions and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import rules, text
from sparkloom.operators import chunking as C
from sparkloom.operators import graph as G
from sparkloom.plans.base import query
from sparkloom.plans.source import CODE_SQL
from sparkloom.plans.source import files as code_files
from sparkloom.sources.tables import table

_LINES = r"CASE WHEN text = '' THEN [] ELSE string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n') END"
_FILE = "source || '/' || doc_id || '.txt'"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file"), "source", "lang", "text")


@query(
    "chunk_windows",
    rf"""WITH l AS (SELECT doc_id, {_FILE} AS file, {_LINES} AS ls FROM documents),
w AS (SELECT doc_id, file, ls, unnest(range(0, len(ls), 4)) AS s FROM l), v AS (SELECT *, ls[s + 1:s + 5] AS p FROM w WHERE s = 0 OR s - 4 + 5 < len(ls))
SELECT doc_id, (s + 1)::INT AS start_line, (s + len(p))::INT AS end_line, sha256('// ' || file || chr(10) || array_to_string(p, chr(10))) AS chunk_sha FROM v
WHERE len(list_filter(p, lambda x: trim(x) <> '')) > 0""",
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 5 lines, 1 shared."""
    return C.windows(_files(spark, sf_dir), "file", "text", 5, 1).select("doc_id", "start_line", "end_line", F.sha2("chunk", 256).alias("chunk_sha"))


_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
_BYLINES = rf"""l AS (SELECT doc_id, {_LINES} AS ls FROM documents),
c0 AS (SELECT doc_id, ls, unnest(range(0, len(ls), 5)) AS s FROM l),
c1 AS (SELECT doc_id, s // 5 AS chunk_no, s, ls[s + 1:s + 5] AS p, CASE WHEN s = 0 THEN 0 ELSE strlen(array_to_string(ls[1:s], chr(10))) + 1 END AS start_byte FROM c0),
c AS (SELECT doc_id, chunk_no, array_to_string(p, chr(10)) AS chunk, s + 1 AS start_line, s + len(p) AS end_line, start_byte, start_byte + strlen(array_to_string(p, chr(10))) AS end_byte FROM c1)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 5 lines."""
    return C.by_lines(_files(spark, sf_dir), "text", 50)


@query("chunk_lines", f"WITH {_BYLINES} SELECT doc_id, chunk_no::INT AS chunk_no, start_line::INT AS start_line, end_line::INT AS end_line, start_byte::BIGINT AS start_byte, end_byte::BIGINT AS end_byte, len({_WORDS.format('chunk')})::INT AS token_count FROM c")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", "start_line", "end_line", "start_byte", F.col("end_byte").cast("long").alias("end_byte"), "token_count")


@query(
    "chunk_overlap_words",
    f"""WITH {_BYLINES}, o AS (SELECT doc_id, chunk_no, chunk, lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS b FROM c),
w AS (SELECT *, {_WORDS.format('b')} AS bw FROM o), v AS (SELECT doc_id, chunk_no, CASE WHEN b IS NOT NULL AND len(bw) > 0 THEN array_to_string(bw[greatest(len(bw) - 7, 1):], ' ') || ' ' || chunk ELSE chunk END AS t FROM w)
SELECT doc_id, chunk_no::INT AS chunk_no, sha256(t) AS chunk_sha, len({_WORDS.format('t')})::INT AS token_count FROM v""",
)
def chunk_overlap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight words carried over."""
    return C.with_overlap(_chunks(spark, sf_dir), "doc_id", words=8).select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("chunk_sha"), "token_count")


@query("chunk_tail_overlap", f"WITH {_BYLINES}, o AS (SELECT doc_id, chunk_no, chunk, lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS b FROM c) SELECT doc_id, chunk_no::INT AS chunk_no, sha256(CASE WHEN b IS NOT NULL THEN right(b, 32) || chr(10) || chunk ELSE chunk END) AS chunk_sha FROM o")
def chunk_tail_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_tail(_chunks(spark, sf_dir), "doc_id", overlap=8).select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("chunk_sha"))


@query("chunk_stats", f"WITH {_BYLINES}, t AS (SELECT len({_WORDS.format('chunk')}) AS n FROM c) SELECT count(*) AS n_chunks, sum(n)::BIGINT AS total, (sum(n) // count(*))::BIGINT AS average, max(n)::BIGINT AS most, min(n)::BIGINT AS least FROM t")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stats(_chunks(spark, sf_dir))


@query("chunk_filter", f"WITH {_BYLINES}, f AS (SELECT c.doc_id, chunk_no, {_FILE} AS file, len({_WORDS.format('chunk')}) AS n FROM c JOIN documents USING (doc_id)) SELECT doc_id, chunk_no::INT AS chunk_no FROM f WHERE regexp_matches(file, '^src1/[^/]*\\.txt$') AND n BETWEEN 20 AND 60")
def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.matching(_chunks(spark, sf_dir), glob="src1/*.txt", low=20, high=60).select("doc_id", "chunk_no")


@query("overlapping_chunks", f"WITH {_BYLINES}, e AS (SELECT doc_id, chunk_no, greatest(start_byte - 40, 0) AS s, end_byte AS e FROM c) SELECT a.doc_id, a.chunk_no::INT AS a, b.chunk_no::INT AS b, round((least(a.e, b.e) - greatest(a.s, b.s)) / (a.e - a.s)::DOUBLE, 6) AS fraction FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.chunk_no < b.chunk_no AND a.s < b.e AND b.s < a.e")
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that begin 40 bytes early, so that they overlap."""
    c = _chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_no")).withColumn("start_byte", F.greatest(F.col("start_byte") - 40, F.lit(0)))
    return C.overlapping(c, "doc_id")


@query("context_at", rf"WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents) SELECT doc_id, len(ls)::INT AS n_lines, trim(coalesce(ls[1], '')) AS line_0, trim(coalesce(ls[3], '')) AS line_3 FROM l")
def context_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.lines(t)).alias("n_lines"), text.line_at(t, 0).alias("line_0"), text.line_at(t, 3).alias("line_3"))


@query("chunk_pack_greedy")
def chunk_pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential fold over each text's lines; tests hold it against plain Python."""
    return C.refined(_files(spark, sf_dir).select("doc_id", "text"), "text", 64).select("doc_id", "part", F.octet_length("text").alias("n_bytes"))


@query(
    "text_scalars",
    rf"""SELECT doc_id, len({_WORDS.format('text')})::INT AS n_tokens, sha256(text) AS hash, substr(sha256({_FILE}), 1, 12) AS project_id,
lower(regexp_replace({_FILE}, '[^\p{{L}}\p{{N}}_-]', '_', 'g')) AS name, CASE WHEN length({_FILE}) > 9 THEN '…' || right({_FILE}, 9) ELSE {_FILE} END AS short, 'context:' || source || ':' || doc_id AS cache_key FROM documents""",
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return f.select("doc_id", text.word_count(F.col("text")).alias("n_tokens"), text.sha256(F.col("text")).alias("hash"), text.project_id(F.col("file")).alias("project_id"), text.sanitized(F.col("file")).alias("name"), text.shortened(F.col("file"), 9).alias("short"), text.cache_key("context", F.col("source"), F.col("doc_id")).alias("cache_key"))


def _scrub_sql(column: str) -> str:
    for pattern, label in rules.SECRETS:
        column = f"regexp_replace({column}, '{pattern.replace("'", "''")}', '{label}', 'g')"
    return column


@query("scrub_secrets", f"SELECT doc_id, sha256({_scrub_sql('text')}) AS scrubbed_sha FROM documents")
def scrub_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.scrubbed(F.col("text")), 256).alias("scrubbed_sha"))


@query("extract_calls", r"SELECT page_id, unnest(regexp_extract_all(html, '(?:^|[^\p{L}\p{N}_])([\p{L}\p{N}_]+)\s*\(', 1)) AS name FROM pages")
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.calls(F.col("html"))).alias("name"))


@query("extract_imports", rf"""WITH {CODE_SQL}, g AS (SELECT url AS file, html AS text FROM pages UNION ALL SELECT file, content FROM f) SELECT file, unnest(list_concat(regexp_extract_all(text, 'use\s+([\w:]+)', 1), regexp_extract_all(text, 'import\s+[\w\*]+\s+from\s+[''"]([^''"]+)[''"]', 1),
regexp_extract_all(text, 'from\s+[''"]([^''"]+)[''"]\s+import', 1), regexp_extract_all(text, 'from\s+([\w.]+)\s+import', 1), regexp_extract_all(text, '#include\s+[<"]([^>"]+)[>"]', 1))) AS name FROM g""")
def extract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages and the inline source files; no given table holds code."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.col("html").alias("content"))
    return pages.unionByName(code_files(spark).select("file", "content")).select("file", F.explode(text.imports(F.col("content"))).alias("name"))


# Graphs: customers are nodes; of each customer's orders of a status the largest links them to the customer of the next order, if that has another status.
_E = """m AS (SELECT o_custkey AS src, o_orderstatus AS status, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS k FROM orders GROUP BY ALL),
e AS (SELECT DISTINCT src, o_custkey AS dst FROM m JOIN orders ON o_orderkey = k + 1 WHERE o_orderstatus <> status), n AS (SELECT c_custkey AS node FROM customer)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    largest = o.groupBy(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("status")).agg((F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")) + 1).alias("o_orderkey"))
    return largest.join(o.drop("o_totalprice"), "o_orderkey").where("o_orderstatus != status").select("src", F.col("o_custkey").alias("dst")).distinct()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))


@query("callers", f"WITH {_E} SELECT src AS caller FROM e WHERE dst = 1")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.callers(edges(spark, sf_dir), 1)


@query("callees", f"WITH {_E} SELECT dst AS callee FROM e WHERE src = 1")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.callees(edges(spark, sf_dir), 1)


@query("neighbours", f"WITH {_E} SELECT DISTINCT dst AS node FROM e WHERE src = 0")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(edges(spark, sf_dir), 0)


@query("entry_points", f"WITH {_E} SELECT node FROM n WHERE node NOT IN (SELECT dst FROM e)")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entry_points(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("leaf_nodes", f"WITH {_E} SELECT node FROM n WHERE node NOT IN (SELECT src FROM e)")
def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.leaves(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("degree_topk", f"WITH {_E} SELECT src AS node, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, node LIMIT 10")
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bottlenecks(edges(spark, sf_dir), 10)


@query("graph_stats", f"WITH {_E} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, round((SELECT count(*) FROM e) / (SELECT count(*) FROM n)::DOUBLE, 6) AS avg_degree")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stats(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("graph_scores", f"WITH {_E} SELECT node, round(count(src) / 100.0::DOUBLE, 6) AS graph_score FROM n LEFT JOIN e ON src = node GROUP BY 1")
def graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = edges(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    return nodes(spark, sf_dir).join(d, "node", "left").select("node", F.round(F.coalesce("d", F.lit(0)) / F.lit(100.0), 6).alias("graph_score"))


@query("bfs_depth3", f"WITH RECURSIVE {_E}, r AS (SELECT c_custkey AS node, 0 AS depth FROM customer WHERE c_nationkey = 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def bfs_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the customers of one nation."""
    start = table(spark, sf_dir, "customer").where("c_nationkey = 0").select(F.col("c_custkey").alias("node"))
    return G.reach(edges(spark, sf_dir), start, 3)


@query("bfs_all", f"WITH RECURSIVE {_E}, r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 40) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def bfs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that one customer reaches, in several rounds."""
    return G.reach(edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long"), 40)


@query("cycle_nodes", f"WITH RECURSIVE {_E}, r AS (SELECT src AS s, dst AS node FROM e UNION SELECT s, dst FROM r JOIN e ON src = node) SELECT DISTINCT node FROM r WHERE s = node")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycle_nodes(edges(spark, sf_dir))


@query(
    "cycle_flags",
    f"""WITH RECURSIVE {_E}, i AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linestatus = 'F'), r AS (SELECT src AS s, dst AS node FROM e UNION SELECT s, dst FROM r JOIN e ON src = node),
x AS (SELECT DISTINCT node FROM r WHERE s = node UNION SELECT a FROM i WHERE a = b) SELECT node, node IN (SELECT node FROM x) AS in_cycle FROM n""",
)
def cycle_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers flagged where they are on a cycle of the order graph or, as a second kind of edge, link to themselves: line items' part to their supplier."""
    second = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).where("src = dst")
    return G.flagged(nodes(spark, sf_dir), [edges(spark, sf_dir), second])


@query(
    "flow_reach",
    """WITH RECURSIVE s AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
e AS (SELECT DISTINCT a AS src, b AS dst FROM s WHERE b IS NOT NULL), r AS (SELECT 'signup' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM r GROUP BY 1""",
)
def flow_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that follow a signup, by the least number of steps."""
    from pyspark.sql import Window

    then = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), then.alias("dst")).where("dst IS NOT NULL").distinct()
    return G.reach(e, spark.createDataFrame([("signup",)], "node string"), 4)
