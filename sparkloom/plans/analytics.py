"""Lookups, aggregates and incremental maintenance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import rules, text
from sparkloom.operators import incremental as I
from sparkloom.operators import lookup as L
from sparkloom.operators import stats as S
from sparkloom.plans.base import query
from sparkloom.plans.retrieval import TOKENS
from sparkloom.plans.source import CODE_SQL
from sparkloom.plans.source import files as code_files
from sparkloom.sources import sinks
from sparkloom.sources.tables import table, webhook_changes


@query("search_text", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contains_any(table(spark, sf_dir, "documents"), "LICENSE", "text").select("doc_id")


@query("search_names", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')")
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contains_any(table(spark, sf_dir, "part"), "Red", "p_name", "p_type").select("p_partkey", "p_name")


@query("related_names", "SELECT p_partkey FROM part WHERE p_name <> 'ring' AND (contains(p_name, 'ring') OR contains('ring', p_name))")
def related_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.related_names(table(spark, sf_dir, "part"), "ring", "p_name").select("p_partkey")


@query("exact_name", "SELECT p_partkey FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 1)")
def exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    first = parts.where("p_partkey = 1").select("p_name").first()
    return parts.where(F.col("p_name") == (first[0] if first else None)).select("p_partkey")


@query("by_kind", "SELECT event_id FROM events WHERE event_type = 'error'")
def by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id")


_LOG = "l AS (SELECT event_id AS id, ts, event_type AS level, 'user' || user_id AS target, props AS message, '' AS span FROM events)"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("level"), F.concat(F.lit("user"), "user_id").alias("target"), F.col("props").alias("message"), F.lit("").alias("span"))


@query("log_page", f"WITH {_LOG} SELECT id, level, target FROM l WHERE level = 'error' AND starts_with(target, 'user1') AND contains(lower(message || ' ' || target || ' ' || span), 'k') AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, id DESC LIMIT 50")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return L.log_page(logs(spark, sf_dir), "error", "user1", "K", since=datetime.datetime(2024, 1, 5), limit=50).select("id", "level", "target")


@query("log_tail", f"WITH {_LOG}, t AS (SELECT * FROM l ORDER BY ts DESC, id DESC LIMIT 200) SELECT id, level FROM t WHERE contains(lower(level), 'err') AND contains(message, '1')")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.log_tail(logs(spark, sf_dir), 200, "ERR", "1").select("id", "level")


@query("ring_buffer", f"WITH {_LOG} SELECT id FROM l ORDER BY ts DESC, id DESC LIMIT 2000")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(2000).select("id")


@query("task_list", "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus IN ('O', 'P') ")
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: open ones are queued, partial ones running."""
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("finished")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), state.alias("state"))
    return L.task_list(t, "active").select("id", "created_at")


@query("language_histogram", "SELECT lang AS language, count(*) AS n_files FROM documents GROUP BY 1")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.language_histogram(table(spark, sf_dir, "documents").withColumnRenamed("lang", "language"))


@query(
    "language_stats",
    r"""WITH f AS (SELECT lang AS language, count(*) AS n_files, sum(len(string_split(text, chr(10)))) AS n_lines FROM documents GROUP BY 1),
s AS (SELECT lang AS language, count(*) AS n_symbols, count(*) FILTER (n_chars % 3 = 0) AS n_functions, count(*) FILTER (n_chars % 3 = 1) AS n_classes FROM documents WHERE lang <> 'es' GROUP BY 1)
SELECT language, n_files, n_lines::BIGINT AS n_lines, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_functions, 0) AS n_functions, coalesce(n_classes, 0) AS n_classes FROM f LEFT JOIN s USING (language)""",
)
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; those that aren't Spanish also as symbols of a kind by their length."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("lang", "language")
    kind = F.when(F.col("n_chars") % 3 == 0, "Function").when(F.col("n_chars") % 3 == 1, "Class").otherwise("Enum")
    return S.language_stats(d.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")), d.where("language != 'es'").withColumn("kind", kind))


_URL = "regexp_extract(url, '://([^/?#]*)', 1)"


@query("module_structure", "SELECT source AS module, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(DISTINCT doc_id) AS n_files, count(*) AS n_symbols FROM documents GROUP BY 1")
def module_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("file"), F.col("lang").alias("language"))
    return S.modules(d)


@query("module_deps", f"SELECT DISTINCT {_URL} AS module, split_part(substr(url, strpos(url, '://') + 3 + length({_URL}) + 1), '/', 1) AS dependency FROM pages WHERE {_URL} <> split_part(substr(url, strpos(url, '://') + 3 + length({_URL}) + 1), '/', 1)")
def module_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rest = F.substring("url", F.instr("url", "://") + 3 + F.length(host) + 1, F.length("url"))
    return S.module_dependencies(table(spark, sf_dir, "pages").select(host.alias("from_file"), rest.alias("to_file")))


@query("project_stats", "SELECT source AS project_id, count(*) AS n_symbols, count(*) AS n_chunks, sum(n_chars)::BIGINT AS tokens, (sum(n_chars) // count(*))::BIGINT AS avg_tokens, count(*) FILTER (lang = 'en') AS n_en FROM documents GROUP BY 1")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("lang").alias("kind"), F.col("n_chars").alias("token_count"))
    return S.project_stats(d, d).withColumn("n_en", F.coalesce(F.element_at("by_kind", "en"), F.lit(0))).drop("by_kind")


@query("storage_stats", "SELECT count(*) AS n_rows, sum(strlen(text))::BIGINT AS total, (sum(strlen(text)) // count(*))::BIGINT AS average, max(strlen(text))::BIGINT AS most, min(strlen(text))::BIGINT AS least FROM documents")
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lengths(table(spark, sf_dir, "documents"), "text")


_FRAMES = " UNION ALL ".join(f"SELECT file, '{n}' AS framework, array_to_string(list_filter([{', '.join(f'CASE WHEN contains(content, $${p}$$) THEN $${p}$$ END' for p in ps)}], lambda x: x IS NOT NULL), ',') AS patterns FROM g WHERE contains(content, '{i}')" for i, n, ps in rules.FRAMEWORKS)


@query("framework_rules", f"WITH {CODE_SQL}, g AS (SELECT url AS file, html AS content FROM pages UNION ALL SELECT file, content FROM f) SELECT * FROM ({_FRAMES}) WHERE patterns <> ''")
def framework_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages and the inline source files; no given table holds code."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.col("html").alias("content"))
    return S.frameworks(pages.unionByName(code_files(spark).select("file", "content")))


def _layer_sql(annots: str, file: str, name: str) -> str:
    at = {"annotation": annots, "file": file, "name": name}
    cases = []
    for where, how, words, of in rules.LAYERS:
        hit = " OR ".join(f"len(list_filter({at[where]}, lambda a: {'contains(a, ' + repr(w) + ')' if how == 'has' else 'a = ' + repr(w)})) > 0" if where == "annotation" else f"contains(lower({at[where]}), '{w}')" for w in words)
        cases.append(f"WHEN {hit} THEN '{of}'")
    return f"CASE {' '.join(cases)} ELSE 'Unknown' END"


#: Annotations that pages take in turn, so that each rule on annotations is met.
_NOTES = ("RestController", "Service", "UserRepo", "Entity", "Filter", "Config", "Other", "Injectable", "Table")


@query("layer_rules", f"SELECT page_id, {_layer_sql(f'[lower({list(_NOTES)!r}[(page_id % {len(_NOTES)} + 1)::INT])]', 'url', 'html')} AS layer FROM pages")
def layer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an annotation each; the rules see the whole page."""
    note = F.get(F.array(*map(F.lit, _NOTES)), (F.col("page_id") % len(_NOTES)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", S.layer(F.array(note), F.col("url"), F.col("html")).alias("layer"))


_USE = "u AS (SELECT event_id AS id, user_id, ts, CASE event_type WHEN 'click' THEN 'openai' WHEN 'view' THEN 'anthropic' WHEN 'signup' THEN 'groq' WHEN 'error' THEN 'ollama' ELSE 'other' END AS provider, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'gpt-4o-mini' ELSE 'gpt-4o' END ELSE 'claude-3-5-sonnet' END AS model, (value * 100)::BIGINT AS tokens FROM events)"
_PRICE = "CASE WHEN provider = 'openai' AND contains(model, 'gpt-4o-mini') THEN 0.15::DOUBLE WHEN provider = 'openai' AND contains(model, 'gpt-4o') THEN 5::DOUBLE WHEN provider = 'anthropic' AND contains(model, 'claude-3-5-sonnet') THEN 3::DOUBLE WHEN provider = 'anthropic' AND contains(model, 'claude-3-5-haiku') THEN 0.25::DOUBLE WHEN provider = 'groq' THEN 0.05::DOUBLE WHEN provider IN ('ollama', 'vllm') THEN 0::DOUBLE END"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of providers; value in hundreds of tokens."""
    who = F.when(F.col("event_type") == "click", "openai").when(F.col("event_type") == "view", "anthropic").when(F.col("event_type") == "signup", "groq").when(F.col("event_type") == "error", "ollama").otherwise("other")
    model = F.when(F.col("event_type") == "click", F.when(F.col("user_id") % 2 == 0, "gpt-4o-mini").otherwise("gpt-4o")).otherwise("claude-3-5-sonnet")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", who.alias("provider"), model.alias("model"), F.round(F.col("value") * 100).cast("long").alias("tokens"))


@query("price_lookup", f"WITH {_USE} SELECT DISTINCT provider, model, {_PRICE} AS price FROM u")
def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.functions import scoring

    return usage(spark, sf_dir).select("provider", "model", scoring.price(F.col("provider"), F.col("model")).alias("price")).distinct()


_COST = f"c AS (SELECT id, user_id, sum(coalesce({_PRICE} * tokens / 1e6, 0)) OVER w AS spend, (sum(tokens) OVER w)::BIGINT AS tokens_used FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts, id))"


@query("cost_running", f"WITH {_USE}, {_COST} SELECT id, round(spend, 8) AS spend, tokens_used FROM c")
def cost_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.costs(usage(spark, sf_dir), 0.01, 0.02, by=("user_id",)).select("id", F.round("spend", 8).alias("spend"), "tokens_used")


@query("cost_guard", f"WITH {_USE}, {_COST} SELECT user_id, count(*) FILTER (round(spend, 9) >= 0.02) AS n_stopped, count(*) FILTER (round(spend, 9) >= 0.01 AND round(spend, 9) < 0.02) AS n_warned FROM c GROUP BY 1")
def cost_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.costs(usage(spark, sf_dir), 0.01, 0.02, by=("user_id",)).withColumn("spend", F.round("spend", 9))
    return c.groupBy("user_id").agg(F.count_if(F.col("spend") >= 0.02).alias("n_stopped"), F.count_if((F.col("spend") >= 0.01) & (F.col("spend") < 0.02)).alias("n_warned"))


_NOW = "TIMESTAMP '2024-01-15 00:00:00'"
_CACHE = "k AS (SELECT event_id AS key, ts AS last_access, CASE WHEN user_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR * (user_id % 48) END AS expires_at FROM events)"


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries; those of every fifth user never expire."""
    life = F.make_dt_interval(hours=(F.col("user_id") % 48).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("last_access"), F.when(F.col("user_id") % 5 != 0, F.col("ts") + life).alias("expires_at"))


def _now() -> Column:
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")


@query("ttl_active", f"WITH {_CACHE} SELECT key FROM k WHERE expires_at IS NULL OR {_NOW} <= expires_at")
def ttl_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.active(cache(spark, sf_dir), _now()).select("key")


@query("cache_stats", f"WITH {_CACHE} SELECT count(*) AS total, count(*) FILTER ({_NOW} > expires_at) AS expired, count(*) FILTER (expires_at IS NULL OR {_NOW} <= expires_at) AS active FROM k")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cache_stats(cache(spark, sf_dir), _now())


@query("lru_keep", f"WITH {_CACHE} SELECT key FROM k ORDER BY last_access DESC, key LIMIT 1000")
def lru_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.last_used(cache(spark, sf_dir), 1000).select("key")


@query("json_explode", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("webhook_paths", "SELECT event_id, unnest(CASE WHEN event_type = 'view' THEN ['h' || user_id, 'x'] ELSE ['a' || user_id, 'b'] END) AS path FROM events")
def webhook_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as push payloads: two paths each, by header for views, else by commits."""
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.concat(F.lit("a"), "user_id")).alias("added"), F.array(F.lit("b")).alias("modified"))).alias("commits")))
    p = table(spark, sf_dir, "events").select("event_id", body.alias("body"), F.when(F.col("event_type") == "view", F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(", x"))).alias("changed_files"))
    return webhook_changes(p).select("event_id", "path")


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("feedback_rate", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM events GROUP BY 1")
def feedback_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(e.agg(F.count("*").alias("all"))), F.lit(True)).select("event_type", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


# Snapshots: documents are files of their source; the new side changes every seventh, drops every eleventh, and adds the benchmark texts.
_OLD = "o AS (SELECT source || '/' || doc_id AS path, sha256(text) AS hash FROM documents)"
_NEW = "nw AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT 'bench/' || item_id, sha256(text) FROM benchmark)"
_DIFF = "d AS (SELECT coalesce(o.path, nw.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN nw.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN nw ON o.path = nw.path WHERE o.hash IS DISTINCT FROM nw.hash)"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/"), "doc_id"))
    old = d.select("path", F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 11 != 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("hash"))
    return old, new.unionByName(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/"), "item_id").alias("path"), F.sha2("text", 256).alias("hash")))


@query("merkle_root", f"WITH {_OLD} SELECT split_part(path, '/', 1) AS project_id, sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path)) AS root FROM o GROUP BY 1")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = snapshots(spark, sf_dir)
    return I.merkle_root(old.withColumn("project_id", F.element_at(F.split("path", "/"), 1)), "project_id")


@query("merkle_diff", f"WITH {_OLD}, {_NEW}, {_DIFF} SELECT path, change FROM d")
def merkle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.diff(*snapshots(spark, sf_dir))


@query("index_stats", f"WITH {_OLD}, {_NEW}, {_DIFF} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change <> 'removed') AS to_index, count(*) AS changed_incl_removed FROM d")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.change_stats(I.diff(*snapshots(spark, sf_dir)), 0).drop("unchanged", "chunks")


@query("incremental_merge", f"WITH {_NEW} SELECT path, hash FROM nw")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the old side brought up to date equals an index of the new side."""
    old, new = snapshots(spark, sf_dir)
    return I.merged(old, new, I.diff(old, new))


@query("delete_by_path", f"WITH {_OLD} SELECT path, hash FROM o WHERE NOT starts_with(path, 'src1/')")
def delete_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = snapshots(spark, sf_dir)
    return sinks.without_paths(old, old.where(F.col("path").startswith("src1/")))


@query("find_usages", f"WITH w AS (SELECT conv_id, turn, unnest({TOKENS}) AS t FROM conversations) SELECT conv_id::VARCHAR AS file, array_to_string(list_sort(list(turn)), ',') AS lines, count(*) AS n FROM w WHERE t = 'the' GROUP BY 1")
def find_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line"), F.explode(text.tokens(F.col("text"))).alias("name"))
    return L.find_usages(c, "the").withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


_THE = r"(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])"


# One pass takes every second of adjacent words, so the SQL makes two.
@query("rename_preview", rf"SELECT conv_id, turn, text AS before, regexp_replace(regexp_replace(text, '{_THE}', '\1THE\2', 'g'), '{_THE}', '\1THE\2', 'g') AS after FROM conversations WHERE regexp_matches(text, '{_THE}')")
def rename_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rename_preview(table(spark, sf_dir, "conversations"), "the", "THE", "text").select("conv_id", "turn", "before", "after")


@query("file_symbols", f"WITH {CODE_SQL} SELECT file, kind, name FROM (VALUES ('lib/a.rb', 'Class', 'Box'), ('lib/a.rb', 'Method', 'open')) v(file, kind, name) JOIN f USING (file)")
def file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule symbols of one file."""
    from sparkloom.operators.symbols import by_rules

    return L.of_file(by_rules(code_files(spark)), "lib/a.rb").select("file", "kind", "name")


@query("dominant_language", "SELECT source AS project_id, arg_max(lang, (n, lang)) AS language FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def dominant_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a project's files; ties go to the greater name, as in the SQL."""
    return S.dominant_language(table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("lang").alias("language")), "project_id")


@query("skip_unchanged", f"WITH {_OLD}, {_NEW} SELECT nw.path FROM nw LEFT JOIN o ON o.path = nw.path AND o.hash = nw.hash WHERE o.path IS NULL")
def skip_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose hash isn't the recorded one: what a pass with a hash cache works on."""
    old, new = snapshots(spark, sf_dir)
    return I.uncached(new, old).select("path")


@query("changed_roots", f"WITH {_OLD}, {_NEW}, a AS (SELECT split_part(path, '/', 1) AS p, sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path)) AS r FROM o GROUP BY 1), b AS (SELECT split_part(path, '/', 1) AS p, sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path)) AS r FROM nw GROUP BY 1) SELECT coalesce(a.p, b.p) AS project_id FROM a FULL JOIN b ON a.p = b.p WHERE a.r IS DISTINCT FROM b.r")
def changed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose root differs; the others need no comparison of files."""
    old, new = (x.withColumn("project_id", F.element_at(F.split("path", "/"), 1)) for x in snapshots(spark, sf_dir))
    return I.changed_roots(old, new, "project_id").select("project_id")
