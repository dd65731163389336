"""Trips to the stored routes and demand tables, positions to congestion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.operators import congestion as signals
from odflow.operators import demand as od
from odflow.operators.covering import cover, zones_of_points
from odflow.operators.gaps import gap_days, gap_ranges
from odflow.session import materialise, small_side
from odflow.sources import drift, upserts
from odflow.sources import trips as trip_files
from odflow.sources.tables import read_table
from odflow.streaming import delays as live

COLORS = ["yellow", "green"]


def ingest_trips(
    spark: SparkSession,
    folder: str,
    as_of: dt.date,
    months: int = 24,
    colors: list[str] | None = None,
    warehouse: str | None = None,
) -> DataFrame:
    """Hourly pairs of the last complete months; merged into ``demand`` if a warehouse is given."""
    colors = colors or COLORS
    trips = trip_files.scan(spark, folder, colors, trip_files.month_range(as_of, months))
    hourly = od.combined_pairs(trips, colors)
    if warehouse:
        rows = upserts.demand_rows(hourly, read_table(spark, warehouse, "routes"))
        upserts.upsert(spark, f"{warehouse}/demand", rows, ["route_id", "hour"], F.col("hour"))
    return hourly


def initialise_routes(
    spark: SparkSession,
    folder: str,
    as_of: dt.date,
    stored: DataFrame,
    months: int = 3,
    threshold: float = od.ROUTE_THRESHOLD,
) -> DataFrame:
    """Routes to add, from the pairs above the monthly threshold."""
    trips = trip_files.scan(spark, folder, COLORS, trip_files.month_range(as_of, months))
    return upserts.new_routes(stored, od.selected_routes(trips, threshold))


def ingest_positions(
    spark: SparkSession, positions: DataFrame, edges: DataFrame, warehouse: str | None = None, size: float = 0.005
) -> DataFrame:
    """Travel-time variance per zone and hour; merged into ``congestion`` if wanted."""
    placed = zones_of_points(signals.position_samples(positions), cover(edges, size))
    variances = signals.zone_variance(placed)
    if warehouse:
        rows = variances.withColumn("disruption_flag", F.lit(False))
        upserts.upsert(spark, f"{warehouse}/congestion", rows, ["zone_id", "hour"], F.col("hour"))
    return variances


def backfill_positions(
    spark: SparkSession,
    positions: DataFrame,
    edges: DataFrame,
    span: DataFrame,
    warehouse: str,
    size: float = 0.005,
    least_hours: int | None = None,
) -> DataFrame:
    """Ingest the days of ``span`` (start, end) that the stored ``congestion`` lacks, all in one job.

    The missing days are at most the days of the span; positions of other days are left out
    before anything is placed. Run again, it finds nothing missing. With ``least_hours`` a day also counts as
    missing where no zone has a row for that many hours on end; its rows are then replaced.
    """
    stored = read_table(spark, warehouse, "congestion")
    lacking = upserts.missing_days(span, stored, "hour")
    if least_hours:
        hours = span.select(F.col("start").cast("timestamp_ntz").alias("start"),
                            (F.col("end").cast("timestamp_ntz") + F.expr("interval 23 hours")).alias("end"))
        anywhere = stored.select("hour", F.lit(0).alias("_all"))
        lacking = lacking.union(gap_days(gap_ranges(anywhere, "_all", hours), least_hours)).distinct()
    days = small_side(lacking)
    samples = signals.position_samples(positions)
    wanted = samples.join(days, F.col("hour").cast("date") == F.col("day"), "left_semi")
    return ingest_positions(spark, wanted, edges, warehouse, size)


def ingest_feeds(
    spark: SparkSession, folder: str, stop_map: DataFrame, warehouse: str, lateness: str | None = None
) -> DataFrame:
    """Take all feed files landed since the last call into the warehouse's delay log; the delay table so far.

    With ``lateness`` a trip counts once per stop and hour, however often it is polled within that time.
    """
    log = f"{warehouse}/delay_log"
    stream = live.landed_feeds(spark, folder)
    if lateness:
        stream = live.unique_polls(stream, lateness)
    live.start_delay_log(stream, stop_map, log, f"{warehouse}/delay_log_progress").awaitTermination()
    return live.read_delays(spark, log)


def ingest_events(spark: SparkSession, path: str, warehouse: str) -> DataFrame:
    """Distinct event dates of files that each hold one JSON list; what has no date is added to ``event_rejects``."""
    rows = materialise(drift.read_events(spark.read.text(path, wholetext=True), "value"), "events")
    good, rejects = drift.split_rejects(rows)
    rejects.write.mode("append").parquet(f"{warehouse}/event_rejects")
    return good.distinct()


def refresh_flags(spark: SparkSession, warehouse: str) -> DataFrame:
    """Recompute the trailing disruption flags and store those that changed."""
    stored = spark.read.parquet(f"{warehouse}/congestion").drop("day")
    # The table is rewritten below, so the updates must not depend on its old files.
    updates = materialise(upserts.flag_updates(stored, signals.congestion_features(stored)))
    rows = stored.drop("disruption_flag").join(updates, ["zone_id", "hour"])
    upserts.upsert(spark, f"{warehouse}/congestion", rows, ["zone_id", "hour"], F.col("hour"))
    return updates
