"""Sinks: snapshots, vectors, registries and logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import known_dimensions


def save_snapshot(tables: dict[str, DataFrame], root: str) -> None:
    """One folder a table, partitioned by project where the table has one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("project_id") if "project_id" in df.columns else w).parquet(f"{root}/{name}")


def load_table(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A saved table; missing or unreadable: empty, with the schema."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def backup(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def restore(spark: SparkSession, root: str, schemas: dict) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).json(f"{root}/{name}") for name, s in schemas.items()}


def replace_projects(df: DataFrame, path: str) -> None:
    """Replaces the partitions of df's projects and leaves the others (dynamic overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def without_paths(rows: DataFrame, paths: DataFrame, column: str = "path") -> DataFrame:
    return rows.join(paths.select(column).distinct(), column, "left_anti")


def without_project(rows: DataFrame, project: str) -> DataFrame:
    return rows.where(F.col("project_id") != project)


def checked_vectors(df: DataFrame, dims: int = 768, column: str = "embedding", model: str | None = None) -> DataFrame:
    """Fails at run time on a vector of another dimension: the model's if it is known, else dims."""
    dims = known_dimensions(model or "") or dims
    return df.withColumn(column, F.when(F.size(column) == dims, F.col(column)).otherwise(F.raise_error(F.lit(f"expected {dims} dimensions"))))


def append_costs(df: DataFrame, path: str) -> None:
    df.select("timestamp", "provider", "model", "tokens", "cost_usd").write.mode("append").json(path)


def save_registry(projects: DataFrame, path: str) -> None:
    projects.orderBy("id").write.mode("overwrite").json(path)
