"""Change feeds and task states as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import incremental
from sparkloom.sources.workers import importable


def files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New files below root as they appear; per_trigger bounds a batch, which is the back pressure."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)


def indexed(changes: DataFrame, target: str, checkpoint: str, index: Callable[[DataFrame], DataFrame], key: str = "path") -> StreamingQuery:
    """Upserts index(batch) into a Parquet table of versions, all that is there, then stops.

    Each batch writes the next version (a whole, committed by its folder's
    _SUCCESS mark) under the batch's number, so a replay overwrites itself.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = index(batch)
        if number:
            old = spark.read.parquet(f"{target}/v{number - 1}")
            fresh = old.join(fresh.select(key), key, "left_anti").unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{target}/v{number}")

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def removals(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths that have vanished: a file stream doesn't tell, a snapshot difference does."""
    return incremental.diff(before, now).where("change = 'removed'").select("path")


#: A task's next state by event; events that don't fit leave it as it is.
MOVES = {("queued", "start"): "running", ("queued", "cancel"): "canceled", ("running", "finish"): "finished", ("running", "fail"): "failed", ("running", "cancel"): "canceled"}


def next_state(state: str, event: str) -> str:
    return MOVES.get((state, event), state)


def task_states(events: DataFrame) -> DataFrame:
    """The last state of each task from its events (task_id, ts, event) in order: a fold over the few events of one task."""
    moves = F.create_map(*[c for (s, e), to in MOVES.items() for c in (F.lit(f"{s}/{e}"), F.lit(to))])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event"))), lambda x: x["event"])
    return events.groupBy("task_id").agg(F.aggregate(ordered, F.lit("queued"), lambda s, e: F.coalesce(moves[F.concat(s, F.lit("/"), e)], s)).alias("state"))


def streaming_task_states(events: DataFrame) -> DataFrame:
    """The same over a stream: (task_id, state) after each batch that touches the task; the state is one string a task."""
    import pandas as pd

    importable(events.sparkSession)

    def step(key, batches, state):
        now = state.get[0] if state.exists else "queued"
        rows = pd.concat(list(batches)).sort_values("ts")
        for e in rows["event"]:
            now = next_state(now, e)
        state.update((now,))
        yield pd.DataFrame({"task_id": [key[0]], "state": [now]})

    return events.groupBy("task_id").applyInPandasWithState(step, "task_id long, state string", "state string", "update", "NoTimeout")


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Extension: counts by event type and window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def progress(query: StreamingQuery, total: int) -> float:
    """Per cent of total rows that a query has taken in."""
    done = sum(p["numInputRows"] for p in query.recentProgress)
    return 100.0 if not total else min(100.0, 100.0 * done / total)
