"""Stop-delay feeds as streams.

The sink is a log of per-batch partial sums. A batch replaces its own folder, so
replaying it after a failure changes nothing; reading the table adds the parts
up. Late rows simply add to their hour, whatever their age.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from odflow.functions.scalars import hour_of
from odflow.operators.congestion import stop_delays
from odflow.sources.upserts import merge_delays

FEED_SCHEMA = (
    "entity array<struct<trip_update: struct<trip: struct<trip_id: string>,"
    " stop_time_update: array<struct<stop_id: string, arrival: struct<delay: double>>>>>>"
)
KEYS = ["zone_id", "hour", "feed_id"]
# One delay counts for each of these, however often it is polled.
POLL_KEYS = ["feed_id", "trip_key", "stop_id", "hour"]


def trip_updates(messages: DataFrame, payload: str, *keep: str) -> DataFrame:
    """``(trip_id, stop_id, delay)`` of every stop update with an arrival delay, from JSON feeds."""
    entity = F.explode(F.from_json(payload, FEED_SCHEMA)["entity"]).alias("entity")
    updates = messages.select(*keep, entity).select(
        *keep, F.col("entity.trip_update.trip.trip_id").alias("trip_id"),
        F.explode("entity.trip_update.stop_time_update").alias("u"),
    )
    return updates.filter(F.col("u.arrival.delay").isNotNull()).select(
        *keep, "trip_id", F.col("u.stop_id").alias("stop_id"), F.col("u.arrival.delay").alias("delay")
    )


def stop_updates(messages: DataFrame, payload: str, *keep: str) -> DataFrame:
    """``(stop_id, delay)`` of every stop update with an arrival delay, from JSON feeds."""
    return trip_updates(messages, payload, *keep).drop("trip_id")


def poll_keys(polls: DataFrame) -> DataFrame:
    """Polls with their hour and ``trip_key``; one without a trip is told apart by its time and delay only."""
    unnamed = F.concat_ws("#", F.col("polled_at").cast("string"), F.col("delay").cast("string"))
    return polls.withColumns({"hour": hour_of(F.col("polled_at")), "trip_key": F.coalesce("trip_id", unnamed)})


def unique_polls(stream: DataFrame, lateness: str) -> DataFrame:
    """The stream of ``(feed_id, trip_id, stop_id, delay, polled_at)`` without repeated polls.

    The first poll of a trip at a stop within an hour is passed on; replayed files and later polls of that hour
    add nothing. The keys seen are state until the newest poll is ``lateness`` past them, and rows
    that late are dropped, as they can no longer be recognised. Of several polls in one micro-batch any one counts:
    take a file per batch where they differ. On a cluster choose the RocksDB state store, so that keys do not
    fill the executors' memory.
    """
    keyed = poll_keys(stream).withColumn("_at", F.col("polled_at").cast("timestamp")).withWatermark("_at", lateness)
    return keyed.dropDuplicatesWithinWatermark(POLL_KEYS).drop("hour", "trip_key", "_at")


def first_polls(polls: DataFrame) -> DataFrame:
    """The batch form of :func:`unique_polls`: the earliest poll of each key, of equals that of the smallest delay."""
    rest = [c for c in polls.columns if c not in ("feed_id", "stop_id", "polled_at", "delay")]
    earliest = F.min(F.struct("polled_at", "delay", *rest)).alias("_first")
    found = poll_keys(polls).groupBy(*POLL_KEYS).agg(earliest)
    return found.select(*[c if c in ("feed_id", "stop_id") else F.col(f"_first.{c}").alias(c) for c in polls.columns])


def placed_stops(stop_map: DataFrame) -> DataFrame:
    """Stops with a zone, as a whole number; the others place no delay."""
    return stop_map.where(F.col("zone_id").isNotNull()).select("stop_id", F.col("zone_id").cast("int").alias("zone_id"))


def partial_delays(delays: DataFrame, stop_map: DataFrame, hour: Column) -> DataFrame:
    """Delay sum and count per zone, hour and feed."""
    placed = stop_delays(delays, hour).join(placed_stops(stop_map), "stop_id")
    return placed.groupBy(*KEYS).agg(F.sum("delay_sum").alias("delay_sum"), F.sum("trip_count").alias("trip_count"))


def append_parts(parts: DataFrame, path: str, batch_id: int) -> None:
    """Store one batch under its id, replacing an earlier attempt at it."""
    parts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start_delay_log(
    stream: DataFrame, stop_map: DataFrame, path: str, checkpoint: str, hour: Column | None = None
) -> StreamingQuery:
    """Run all available input into the log at ``path``; needs no state.

    ``stream`` has ``(stop_id, delay, feed_id, polled_at)``; the hour is that of
    the poll unless given.
    """
    at = hour_of(F.col("polled_at")) if hour is None else hour

    def store(batch: DataFrame, batch_id: int) -> None:
        append_parts(partial_delays(batch, stop_map, at), path, batch_id)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _parts(spark: SparkSession, path: str, base: str | None, upto: int | None) -> DataFrame:
    parts = spark.read.parquet(path)
    if base is None:
        return parts.drop("batch_id")
    folded = spark.read.parquet(f"{base}/upto={upto}")
    return parts.filter(F.col("batch_id") > upto).drop("batch_id").unionByName(folded)


def read_delays(
    spark: SparkSession, path: str, base: str | None = None, upto: int | None = None
) -> DataFrame:
    """The delay table: mean and count over all batches of the log.

    With ``base`` the batches up to ``upto`` are taken from :func:`fold_log`.
    """
    sums = _parts(spark, path, base, upto).groupBy(*KEYS).agg(
        F.sum("delay_sum").alias("s"), F.sum("trip_count").alias("trip_count")
    )
    return sums.select(*KEYS, F.try_divide("s", "trip_count").alias("mean_delay"), "trip_count")


def fold_log(spark: SparkSession, path: str, base: str, upto: int) -> None:
    """Add up the batches up to ``upto`` into one table below ``base``.

    Keeps reads short after many batches. The log itself is left alone, so a
    repeated fold, or a batch replayed later, gives the same table.
    """
    parts = spark.read.parquet(path).filter(F.col("batch_id") <= upto)
    sums = parts.groupBy(*KEYS).agg(
        F.sum("delay_sum").alias("delay_sum"), F.sum("trip_count").alias("trip_count")
    )
    sums.write.mode("overwrite").parquet(f"{base}/upto={upto}")


def windowed_delays(stream: DataFrame, stop_map: DataFrame, lateness: str) -> DataFrame:
    """Continuous aggregate with hourly event-time windows, for update mode.

    State of an hour is dropped once the newest event is ``lateness`` past it;
    rows arriving later than that are not counted, so use the log above when
    every row must count.
    """
    timed = stream.withColumn("_ts", F.col("polled_at").cast("timestamp"))
    return (
        timed.withWatermark("_ts", lateness)
        .join(placed_stops(stop_map), "stop_id")
        .groupBy(F.window("_ts", "1 hour").alias("w"), "zone_id", "feed_id")
        .agg(F.sum("delay").alias("delay_sum"), F.count("delay").alias("trip_count"))
        .select(
            "zone_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "feed_id",
            "delay_sum", "trip_count",
        )
    )


def start_windowed(
    stream: DataFrame, stop_map: DataFrame, path: str, checkpoint: str, lateness: str
) -> StreamingQuery:
    """Update-mode run of :func:`windowed_delays`: each batch stores the new totals.

    Rows dropped for being later than ``lateness`` are counted by :func:`dropped_rows`.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        append_parts(batch, path, batch_id)

    return (
        windowed_delays(stream, stop_map, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dropped_rows(run: StreamingQuery) -> int:
    """Rows that the watermark of a run has dropped so far, by the progress it still holds."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in run.recentProgress for s in p["stateOperators"])


def _latest(totals: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("delay_sum", "trip_count"), "batch_id").alias("last")
    return totals.groupBy(*KEYS).agg(last).select(*KEYS, "last.delay_sum", "last.trip_count")


def read_windowed(
    spark: SparkSession, path: str, base: str | None = None, upto: int | None = None
) -> DataFrame:
    """Latest totals per key over the batches of an update-mode run.

    With ``base`` the batches up to ``upto`` are taken from :func:`fold_windowed`.
    """
    totals = spark.read.parquet(path)
    if base is not None:
        folded = spark.read.parquet(f"{base}/upto={upto}").withColumn("batch_id", F.lit(upto))
        totals = totals.filter(F.col("batch_id") > upto).unionByName(folded)
    return _latest(totals).select(*KEYS, F.try_divide("delay_sum", "trip_count").alias("mean_delay"), "trip_count")


def fold_windowed(spark: SparkSession, path: str, base: str, upto: int) -> None:
    """Keep the newest totals of the batches up to ``upto`` as one table below ``base``."""
    totals = _latest(spark.read.parquet(path).filter(F.col("batch_id") <= upto))
    totals.write.mode("overwrite").parquet(f"{base}/upto={upto}")


def landed_feeds(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON feed messages landed below ``folder/feed_id=<id>/``, one per file, as a stream of stop delays.

    A file is polled when it was last changed. Files that hold no message give no rows.
    """
    files = (
        spark.readStream.schema("value string, feed_id string")
        .option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    )
    polled = F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("polled_at")
    return trip_updates(files.select("value", "feed_id", polled), "value", "feed_id", "polled_at")


def add_poll(stored: DataFrame, polled: DataFrame) -> DataFrame:
    """Stored delay rows merged with those of one more poll."""
    return merge_delays(stored.unionByName(polled))
