"""Arrow batches in, Arrow batches out: bounded memory for Python operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that Spark hands to Python at once, and bytes of results that are held before they are handed back.
ROWS, HELD = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Documents can be long: hand few of them to Python at a time.  Workers on this machine find the package where the driver does."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def give_back() -> None:
    """At a task's end: memory that Arrow and the C library keep for later goes back to the system, since a worker lives on through the stages after."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of the named columns as Python values."""
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def gathered(rows: Iterable[tuple], schema: pa.Schema, weigh=None) -> Iterator[pa.RecordBatch]:
    """Batches of the rows; one ends after 4,096 rows or when weigh(row) bytes add up to HELD."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weigh(r) if weigh else 0
        if len(held) >= 4096 or size >= HELD:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
