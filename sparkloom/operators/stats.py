"""Aggregates: projects, languages, modules, costs, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import rules, scoring, text


def project_stats(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """By project: symbols, symbols by kind, chunks, tokens and their integer mean."""
    kinds = symbols.groupBy("project_id", "kind").agg(F.count("*").alias("n"))
    s = kinds.groupBy("project_id").agg(F.sum("n").alias("n_symbols"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    c = chunks.groupBy("project_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"))
    return s.join(c, "project_id", "full").withColumn("avg_tokens", F.coalesce(F.expr("tokens div n_chunks"), F.lit(0)))


def lengths(df: DataFrame, column: str) -> DataFrame:
    """Count, and sum, integer mean, most and least of the byte lengths; 0 on an empty table."""
    n = df.select(F.octet_length(column).cast("long").alias("n"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return n.agg(F.count("*").alias("n_rows"), z(F.sum("n")).alias("total"), z(F.expr("sum(n) div count(n)")).alias("average"), z(F.max("n")).alias("most"), z(F.min("n")).alias("least"))


def language_histogram(files: DataFrame, language: str = "language") -> DataFrame:
    return files.groupBy(language).agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), language)


def dominant_language(files: DataFrame, *by: str, merged: tuple[tuple[str, str], ...] = (("typescript", "javascript"),)) -> DataFrame:
    """The language of most files (by by): TypeScript counts as JavaScript; ties go to the greater name; files without a language don't count."""
    lang = F.col("language")
    for a, b in merged:
        lang = F.when(lang == a, b).otherwise(lang)
    n = files.where("language IS NOT NULL").groupBy(*by, lang.alias("language")).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max_by("language", F.struct("n", "language")).alias("language"))


def language_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """By language: files and lines, and symbols, functions and classes; languages without symbols stay."""
    f = files.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"))
    has = lambda *k: F.count_if(F.col("kind").isin(*k))
    s = symbols.groupBy("language").agg(F.count("*").alias("n_symbols"), has("Function", "Method").alias("n_functions"), has("Class", "Struct", "Interface").alias("n_classes"))
    return f.join(s, "language", "left").na.fill(0, ["n_symbols", "n_functions", "n_classes"])


def modules(symbols: DataFrame) -> DataFrame:
    """By first path segment: languages, files, symbols."""
    m = symbols.withColumn("module", F.element_at(F.split("file", "/"), 1))
    return m.groupBy("module").agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.count_distinct("file").alias("n_files"), F.count("*").alias("n_symbols")).orderBy("module")


def module_layer(layers: Column) -> Column:
    """Of an array of layers: the first present of Controller, Service, Repository and Model."""
    out = F.lit("Unknown")
    for name in ("Model", "Repository", "Service", "Controller"):
        out = F.when(F.array_contains(layers, name), name).otherwise(out)
    return out


def module_dependencies(imports: DataFrame) -> DataFrame:
    """Distinct (module, dependency) by first path segments, without itself."""
    first = lambda c: F.element_at(F.split(c, "/"), 1)
    return imports.select(first("from_file").alias("module"), first("to_file").alias("dependency")).where("module != dependency").distinct()


def detected_modules(files: DataFrame) -> DataFrame:
    """Folders with a marker file: the first marker in order decides."""
    marker = F.element_at(F.split("file", "/"), -1)
    order, langs = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, (name, of) in enumerate(rules.MARKERS):
        order, langs = F.when(marker == name, k).otherwise(order), F.when(marker == name, of).otherwise(langs)
    d = files.withColumn("_k", order).withColumn("_l", langs).where("_k IS NOT NULL").withColumn("dir", F.regexp_replace("file", r"/?[^/]*$", ""))
    return d.groupBy("dir").agg(F.min_by("_l", "_k").alias("languages"), F.min_by(marker, F.col("_k")).alias("marker")).orderBy("dir")


def _names(word: str, how: str):
    return (lambda a: a.contains(word)) if how == "has" else (lambda a: a == word)


def layer(annotations: Column, file: Column, name: Column) -> Column:
    """The first rule that fits; annotations is an array of names."""
    low = F.transform(annotations, F.lower)
    out = F.lit("Unknown")
    for where, how, words, of in reversed(rules.LAYERS):
        hit = F.lit(False)
        for w in words:
            if where == "annotation":
                hit = hit | F.exists(low, _names(w, how))
            else:
                hit = hit | F.lower(file if where == "file" else name).contains(w)
        out = F.when(F.coalesce(hit, F.lit(False)), of).otherwise(out)
    return out


def frameworks(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """A row for each framework of a file, with the patterns found.  One pass: the rules are an array of conditional structs."""
    found = []
    for needle, name, patterns in rules.FRAMEWORKS:
        hits = F.filter(F.array(*[F.when(F.col(content).contains(p), p) for p in patterns]), lambda x: x.isNotNull())
        found.append(F.when(F.col(content).contains(needle), F.struct(F.lit(name).alias("framework"), hits.alias("patterns"))))
    rows = files.select(*keep, F.explode(F.array(*found)).alias("f"))
    return rows.where("f IS NOT NULL AND size(f.patterns) > 0").select(*keep, "f.framework", F.array_join("f.patterns", ",").alias("patterns"))


def costs(usage: DataFrame, warn: float, most: float, order: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Running spend of priced rows (provider, model, tokens), and ok, warn or stop after each.  The running order is within by; give one for large logs."""
    u = usage.withColumn("price", scoring.price(F.col("provider"), F.col("model"))).withColumn("cost", F.coalesce(F.col("price") * F.col("tokens") / F.lit(1e6), F.lit(0.0)))
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy(order, "id").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("spend", F.sum("cost").over(w)).withColumn("tokens_used", F.sum("tokens").over(w))
    return u.withColumn("state", F.when(F.col("spend") >= most, "stop").when(F.col("spend") >= warn, "warn").otherwise("ok"))


def cache_stats(entries: DataFrame, now: Column) -> DataFrame:
    gone = F.coalesce(now > F.col("expires_at"), F.lit(False))
    return entries.agg(F.count("*").alias("total"), F.count_if(gone).alias("expired"), F.count_if(~gone).alias("active"))


def active(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired; a null expiry never does."""
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def fallback(files: DataFrame) -> DataFrame:
    return files.withColumn("summary", text.fallback_summary(F.col("content"), text.word_count(F.col("content"))))
