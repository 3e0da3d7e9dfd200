"""Queries that run a stream over what is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import watch
from .base import Family

family = Family()
QUERIES, SQL = family.queries, family.sql


def _run(spark, df):
    return watch.written(df, watch.shared_folder(spark))


def _events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return watch.watched(spark, f"{sf_dir}/[e]vents.parquet", schema)


@family.over(None, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, sf_dir):
    """The last state of each window."""
    rows = _run(spark, watch.event_windows(_events(spark, sf_dir)))
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


@family.over(None, "SELECT user_id, least(count(*), 50)::INT AS kept, max(event_id) AS newest FROM events GROUP BY 1")
def stream_undo_sessions(spark, sf_dir):
    out = _run(spark, watch.last_of_sessions(_events(spark, sf_dir)))
    return out.groupBy("user_id").agg(F.max("kept").alias("kept"), F.max("newest").alias("newest"))


@family.over(None, """SELECT user_id, least(count(*), 50)::INT AS kept, max(event_id) AS newest FROM events GROUP BY 1
    HAVING epoch_ms(max(ts)) + 6 * 3600 * 1000 < (SELECT epoch_ms(max(ts)) - 3600 * 1000 FROM events)""")
def stream_sessions_closed(spark, sf_dir):
    """Users whose state went for six idle hours before the watermark."""
    out = _run(spark, watch.last_of_sessions(_events(spark, sf_dir), idle="6 hours"))
    return out.filter("closed").select("user_id", "kept", "newest")
