"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset: a temporary folder if everything runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_sparkloom_shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark._sparkloom_shared = found
    return found.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of df, from a table written into the shared folder: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
