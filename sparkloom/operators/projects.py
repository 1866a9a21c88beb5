"""The project catalogue, providers and query caches as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def added(projects: DataFrame, new: DataFrame) -> DataFrame:
    """projects (name, root, created_at, is_default) with new ones; a known name is an error at run time, the first project becomes the default."""
    both = projects.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    n = F.count("*").over(Window.partitionBy("name"))
    both = both.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("project exists: "), "name"))))
    return with_default(both.drop("_new"))


def with_default(projects: DataFrame) -> DataFrame:
    """is_default on the project that has it, else on the earliest (ties by name).  A catalogue is small; one window orders it."""
    first = F.row_number().over(Window.orderBy(F.coalesce(F.col("is_default"), F.lit(False)).desc(), "created_at", "name"))
    return projects.withColumn("is_default", first == 1)


def removed(projects: DataFrame, name: str) -> DataFrame:
    return with_default(projects.where(F.col("name") != name))


def without_ghosts(projects: DataFrame) -> DataFrame:
    """Projects whose root was never set are dropped."""
    return projects.where("root != 'default_value'")


def indexed(projects: DataFrame, files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Each project with its files and how many of them have a known hash."""
    n = files.groupBy("project_id").agg(F.count("*").alias("n_files"))
    h = hashes.groupBy("project_id").agg(F.count("*").alias("n_indexed"))
    return projects.join(n, "project_id", "left").join(h, "project_id", "left").na.fill(0, ["n_files", "n_indexed"])


def provider_status(providers: DataFrame) -> DataFrame:
    return providers.agg(F.count("*").alias("total"), F.count_if("healthy").alias("healthy"))


def cached(cache: DataFrame, project, query, k, filters) -> DataFrame:
    """A query's cached rows; the key holds all that the result depends on."""
    return cache.where((F.col("project_id") == project) & (F.col("query_sha") == F.sha2(F.lit(query), 256)) & (F.col("k") == k) & F.col("filters").eqNullSafe(F.lit(filters)))


def stale(results: DataFrame, current) -> DataFrame:
    """Marks results of an index with another fingerprint than the current one."""
    return results.withColumn("stale", ~F.col("fingerprint").eqNullSafe(F.lit(current)))


def file_dependencies(symbols: DataFrame, snippet: str = "context_snippet") -> DataFrame:
    """Imports named in a file's snippets, without empty ones and the standard library's."""
    from sparkloom.functions import text

    d = symbols.select("file", F.explode(text.imports(F.col(snippet))).alias("dependency"))
    return d.where("dependency != '' AND NOT startswith(dependency, 'std::')")
