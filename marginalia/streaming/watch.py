"""Streaming forms: watched folders, caches with a lifetime, sessions (2.13; windows are an extension)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import annotations


def watched(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rebuild(stream: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str):
    """The build of each batch of changed documents, once all files that are there have been seen."""
    return stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def annotation_counts(stream: DataFrame, *keep: str) -> DataFrame:
    """AGG-01 over a stream: no state is kept."""
    return annotations.counts(stream, *keep)


def event_windows(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """EXTENSION: events by type and window of event time; windows close when the watermark has passed."""
    w = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


SESSIONS = "user_id long, kept int, newest long, closed boolean"


def last_of_sessions(stream: DataFrame, most: int = 50, idle: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Undo stacks: for each user the number of states kept, at most `most`, and the newest one.

    A user's state goes `idle` after the last event, by event time, once the
    watermark has passed; a row with `closed` then says what it was.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, last = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "kept": [len(kept)], "newest": [kept[-1]], "closed": [True]})
            return
        for pdf in frames:
            kept = sorted([*kept, *pdf["event_id"].tolist()])[-most:]
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        state.update((kept, last))
        # a late event must not set an end that has passed
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "kept": [len(kept)], "newest": [kept[-1]], "closed": [False]})

    timed = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(update, SESSIONS, "kept array<long>, last long", "update", GroupStateTimeout.EventTimeTimeout)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marginalia-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def written(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Run the stream over all that is there and give its rows with `batch`, read from files.

    A batch that runs again overwrites its own files, and a second call with
    the same folder goes on behind the first, by the checkpoint in it.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(f"{folder}/rows")
