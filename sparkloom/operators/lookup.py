"""Filters and lookups on symbols, chunks, logs and tasks.  All are predicates that Catalyst pushes to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_any(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows where any column holds query, regardless of case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return df.where(hit)


def at_line(chunks: DataFrame, file: str, line: int) -> DataFrame:
    return chunks.where((F.col("file") == file) & (F.col("start_line") <= line) & (F.col("end_line") >= line))


def of_file(rows: DataFrame, file: str) -> DataFrame:
    """Symbols or chunks of one file."""
    return rows.where(F.col("file") == file)


def related_names(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Another name that holds this one or is held by it."""
    c = F.col(column)
    return df.where((c != name) & (c.contains(name) | F.contains(F.lit(name), c)))


def first_named(df: DataFrame, name: str, ordinal: str, column: str = "name") -> DataFrame:
    return df.where(F.col(column) == name).orderBy(ordinal).limit(1)


def unused(symbols: DataFrame, references: DataFrame) -> DataFrame:
    return symbols.join(references.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def log_page(logs: DataFrame, level: str | None = None, target: str | None = None, holds: str | None = None, since=None, until=None, cursor: tuple | None = None, limit: int = 500) -> DataFrame:
    """Newest first, after cursor (ts, id); limit 5,000 at most.  Rows without a time pass the time filters."""
    if level:
        logs = logs.where(F.col("level") == level)
    if target:
        logs = logs.where(F.col("target").startswith(target))
    if holds:
        logs = logs.where(F.lower(F.concat_ws(" ", "message", "target", "span")).contains(holds.lower()))
    if since is not None:
        logs = logs.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(since)))
    if until is not None:
        logs = logs.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(until)))
    if cursor:
        logs = logs.where((F.col("ts") < F.lit(cursor[0])) | ((F.col("ts") == F.lit(cursor[0])) & (F.col("id") < cursor[1])))
    return logs.orderBy(F.desc("ts"), F.desc("id")).limit(min(limit, 5000))


def log_tail(logs: DataFrame, n: int, level: str | None = None, holds: str | None = None) -> DataFrame:
    """The last n lines first, filters after."""
    t = logs.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    if level:
        t = t.where(F.lower("level").contains(level.lower()))
    return t.where(F.col("message").contains(holds)) if holds else t


#: States of each class.
STATES = {"active": ("queued", "running"), "finished": ("finished", "failed", "canceled")}


def task_list(tasks: DataFrame, state: str | None = None, project: str | None = None) -> DataFrame:
    if state:
        tasks = tasks.where(F.col("state").isin(*STATES[state]))
    if project:
        tasks = tasks.where(F.col("project_id") == project)
    return tasks.orderBy(F.desc("created_at"), "id")


def can_access(projects: Column, project: Column) -> Column:
    return F.array_contains(projects, "*") | F.array_contains(projects, project)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Any pattern is a substring."""
    return F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(path, p))


def find_usages(references: DataFrame, symbol: str) -> DataFrame:
    """Places by file, and each file's number of them."""
    r = references.where(F.col("name") == symbol)
    return r.groupBy("file").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.count("*").alias("n")).orderBy("file")


def find_definition(symbols: DataFrame, name: str, scope: str | None = None) -> DataFrame:
    """By qualified name, else by name within the scope hint, else all of that name; level 1, 2 or 3."""
    c = F.when(F.col("qualified_name") == name, 1).when((F.col("name") == name) & F.col("file").startswith(scope or "\0"), 2).when(F.col("name") == name, 3)
    found = symbols.withColumn("level", c).where("level IS NOT NULL")
    return found.withColumn("_best", F.min("level").over(Window.partitionBy(F.lit(0)))).where("level = _best").drop("_best").orderBy("file", "start_line")


def rename_preview(lines: DataFrame, old: str, new: str, content: str = "content") -> DataFrame:
    """Lines that hold the whole word, before and after."""
    import re

    word = rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(old)}(?![\p{{L}}\p{{N}}_])"
    return lines.where(F.col(content).rlike(word)).withColumn("before", F.col(content)).withColumn("after", F.regexp_replace(content, word, "$1" + new.replace("$", "\\$")))


def symbol_map(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start_line", "kind", "name"))).alias("symbols"))


def annotated(chunks: DataFrame, cycled: DataFrame, content: str = "content") -> DataFrame:
    """A warning line before chunks that name a symbol (word) on a cycle, the least such name.  Words are exploded and joined, not scanned against each name."""
    words = chunks.select("chunk_id", F.explode(F.array_distinct(F.split(content, r"[^\p{L}\p{N}_]+"))).alias("name"))
    first = words.join(cycled.select("name").distinct(), "name").groupBy("chunk_id").agg(F.min("name").alias("_name"))
    j = chunks.join(first, "chunk_id", "left")
    return j.withColumn(content, F.when(F.col("_name").isNotNull(), F.concat(F.lit("// WARNING: part of a dependency cycle: "), "_name", F.lit("\n"), content)).otherwise(F.col(content))).drop("_name")
