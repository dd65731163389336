"""Streaming jobs, compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.functions.scalars import hour_of
from odflow.operators import congestion as signals
from odflow.queries.base import query, with_tables
from odflow.session import scratch_path
from odflow.sources import driver_tables as src
from odflow.streaming import delays as live

BATCH = with_tables(
    "delay_parts",
    "SELECT zone_id, hour, feed_id, round(mean_delay, 6) AS mean_delay, trip_count FROM delay_parts",
)


def event_stream(spark, folder):
    """``events.parquet`` as a stream of stop delays."""
    schema = src.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return raw.select(
        F.col("user_id").cast("string").alias("stop_id"),
        F.col("value").alias("delay"),
        F.col("event_type").alias("feed_id"),
        F.col("ts").alias("polled_at"),
    )


def message():
    """An event as a JSON feed message: one update with a delay, one without."""
    return F.format_string(
        '{"entity": [{"trip_update": {"stop_time_update": [{"stop_id": "%s", "arrival": {"delay": %s}},'
        ' {"stop_id": "%s", "arrival": {}}]}}, {"vehicle": {"id": "%s"}}]}',
        F.col("user_id").cast("string"), F.col("value").cast("string"),
        F.col("user_id").cast("string"), F.col("event_id").cast("string"),
    )


@query(
    "feed_updates",
    "SELECT event_id, CAST(user_id AS VARCHAR) AS stop_id, value AS delay FROM events",
)
def feed_updates(spark, folder):
    messages = src.table(spark, folder, "events").select("event_id", message().alias("payload"))
    return live.stop_updates(messages, "payload", "event_id")


@query("delay_log_stream", BATCH)
def delay_log_stream(spark, folder):
    """Stateless stream into the log of partial sums, then read back as the delay table."""
    path, checkpoint = scratch_path(spark, "delays"), scratch_path(spark, "delays-progress")
    run = live.start_delay_log(event_stream(spark, folder), src.stop_map(spark, folder), path, checkpoint)
    run.awaitTermination()
    return live.read_delays(spark, path)


@query("delay_window_stream", BATCH)
def delay_window_stream(spark, folder):
    """Event-time windows in update mode."""
    path, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "windows-progress")
    run = live.start_windowed(
        event_stream(spark, folder), src.stop_map(spark, folder), path, checkpoint, "60 days"
    )
    run.awaitTermination()
    return live.read_windowed(spark, path)


@query(
    "feed_stream",
    BATCH,
)
def feed_stream(spark, folder):
    """JSON feed messages, parsed in the stream and aggregated into the log."""
    schema = src.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    messages = raw.select(message().alias("payload"), F.col("event_type").alias("feed_id"), "ts")
    updates = live.stop_updates(messages, "payload", "feed_id", "ts").withColumnRenamed("ts", "polled_at")
    path, checkpoint = scratch_path(spark, "feed"), scratch_path(spark, "feed-progress")
    run = live.start_delay_log(
        updates, src.stop_map(spark, folder), path, checkpoint, hour_of(F.col("polled_at"))
    )
    run.awaitTermination()
    return live.read_delays(spark, path)


def repeated_polls(raw):
    """Every event as a poll of a trip, and the same poll once more at the end of its hour.

    The delay follows from the key, so that it does not matter which poll of a batch is met first.
    """
    hour = hour_of(F.col("ts"))
    delay = F.pmod("user_id", F.lit(30)) + F.hour("ts") * 2.5
    times = F.array(F.col("ts"), hour + F.expr("INTERVAL '59:59' MINUTE TO SECOND"))
    return raw.select(
        F.col("user_id").cast("string").alias("stop_id"),
        delay.alias("delay"),
        F.col("event_type").alias("feed_id"),
        F.pmod("user_id", F.lit(17)).cast("string").alias("trip_id"),
        F.explode(times).alias("polled_at"),
    )


UNIQUE = """
    SELECT s_nationkey AS zone_id, hour, feed_id, round(avg(delay), 6) AS mean_delay, count(*) AS trip_count
    FROM (SELECT DISTINCT user_id, event_type AS feed_id, date_trunc('hour', ts) AS hour, user_id % 30 + hour(ts) * 2.5 AS delay
          FROM events) JOIN supplier ON user_id = s_suppkey GROUP BY 1, 2, 3"""


@query("unique_poll_stream", UNIQUE)
def unique_poll_stream(spark, folder):
    """Polls that come twice, deduplicated in the stream's state before they reach the log."""
    schema = src.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    path, checkpoint = scratch_path(spark, "unique"), scratch_path(spark, "unique-progress")
    polls = live.unique_polls(repeated_polls(raw), "60 days")
    live.start_delay_log(polls, src.stop_map(spark, folder), path, checkpoint).awaitTermination()
    return live.read_delays(spark, path)


@query("first_polls", UNIQUE)
def first_polls(spark, folder):
    """The same in one batch."""
    polls = live.first_polls(repeated_polls(src.table(spark, folder, "events")))
    return signals.zone_delays(polls, src.stop_map(spark, folder), hour_of(F.col("polled_at")))
