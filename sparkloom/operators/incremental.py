"""Snapshots, differences and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merkle_root(snapshot: DataFrame, by: str | None = None, buckets: int | None = None) -> DataFrame:
    """sha256 over path:hash lines in path order, for each value of by.

    A root over one very large project can be taken in two levels (buckets): the
    roots of hash buckets of paths, then the root over those; it is another
    value, to be used on both sides of a comparison.
    """
    keys = [by] if by else []
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "hash"))), lambda x: F.concat(x["path"], F.lit(":"), x["hash"])), "\n")
    if buckets:
        low = snapshot.groupBy(*keys, F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("string").alias("path")).agg(F.sha2(lines, 256).alias("hash"))
        return merkle_root(low.select(*keys, "path", "hash"), by)
    return snapshot.groupBy(*keys).agg(F.sha2(lines, 256).alias("root"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified."""
    o, n = old.select("path", F.col("hash").alias("o")), new.select("path", F.col("hash").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return o.join(n, "path", "full").withColumn("change", change).where("change IS NOT NULL").select("path", "change")


def changed_roots(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Values of by (projects) whose root differs or that only one side has; where roots are equal there is nothing to compare."""
    o, n = merkle_root(old, by).withColumnRenamed("root", "o"), merkle_root(new, by).withColumnRenamed("root", "n")
    return o.join(n, by, "full").where("NOT (o <=> n)").select(by)


def uncached(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """files (path, hash) that aren't recorded with that hash.  Record hashes after the work on them has succeeded."""
    return files.join(recorded.select("path", "hash"), ["path", "hash"], "left_anti")


def to_index(changes: DataFrame) -> DataFrame:
    return changes.where("change != 'removed'").select("path")


def change_stats(changes: DataFrame, total: int, chunks: int = 0) -> DataFrame:
    n = lambda x: F.count_if(F.col("change") == x)
    return changes.agg(n("added").alias("added"), n("modified").alias("modified"), n("removed").alias("removed"), (n("added") + n("modified")).alias("to_index"), F.count("*").alias("changed_incl_removed"), (F.lit(total) - n("added") - n("modified")).alias("unchanged"), F.lit(chunks).alias("chunks"))


def merged(rows: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """rows without those of changed or removed paths, and the fresh rows of what was indexed anew."""
    kept = rows.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(fresh.join(to_index(changes), "path", "left_semi"))


def patched(symbols: DataFrame, edges: DataFrame, changed: DataFrame, new_symbols: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges (file_src, file_dst) after changed files (file) were analysed again."""
    s = symbols.join(changed.select("file"), "file", "left_anti").unionByName(new_symbols)
    e = edges
    for side in ("file_src", "file_dst"):
        e = e.join(changed.select(F.col("file").alias(side)), side, "left_anti")
    return s, e.unionByName(new_edges, allowMissingColumns=True)


def index_changes(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """What an incremental run does: removed and modified paths go, added and modified (or, forced, all) are indexed."""
    d = diff(old, new)
    if not force:
        return d
    return d.where("change = 'removed'").unionByName(new.join(old.select("path"), "path", "left").select("path").withColumn("change", F.lit("modified"))).distinct()


def last_used(entries: DataFrame, keep: int) -> DataFrame:
    """The most recently used entries: a query cache's content at its capacity."""
    return entries.orderBy(F.desc("last_access"), "key").limit(keep)
