"""Zone signals: travel-time variance, stop delays and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.functions import windows as win
from odflow.functions.scalars import hour_of, low_confidence

# Fixed values.
FLAG_ROWS = 168
FLAG_SIGMAS = 2.0


def position_samples(positions: DataFrame) -> DataFrame:
    """Positions with ``hour``, ``segment_travel_time``, ``longitude`` and ``latitude``.

    The travel time falls back to ``travel_time``, then to 0.0; the time to
    ``time``. Without coordinates nothing can be placed, so nothing is left.
    """
    columns = set(positions.columns)
    if "segment_travel_time" not in columns:
        value = F.col("travel_time") if "travel_time" in columns else F.lit(0.0)
        positions = positions.withColumn("segment_travel_time", value)
    if "timestamp" in columns:
        at = "timestamp"
    elif "time" in columns:
        at = "time"
    else:
        raise ValueError("positions need a timestamp or time column")
    positions = positions.withColumn("hour", hour_of(F.col(at).cast("timestamp_ntz")))
    if not {"latitude", "longitude"} <= columns:
        return positions.withColumns(
            {"longitude": F.lit(None).cast("double"), "latitude": F.lit(None).cast("double")}
        ).filter(F.lit(False))
    return positions


def zone_variance(samples: DataFrame) -> DataFrame:
    """Sample variance (0 for a single sample) and sample count per zone and hour."""
    return samples.groupBy("zone_id", "hour").agg(
        F.coalesce(F.var_samp("segment_travel_time"), F.lit(0.0)).alias("travel_time_var"),
        F.count("segment_travel_time").alias("sample_count"),
    )


def zone_delays(delays: DataFrame, stop_map: DataFrame, hour: Column) -> DataFrame:
    """Mean delay and count per zone, hour and feed; stops without a zone are dropped."""
    sums = stop_delays(delays, hour).join(stop_map.dropna(subset=["zone_id"]), "stop_id").groupBy(
        F.col("zone_id").cast("int").alias("zone_id"), "hour", "feed_id"
    ).agg(F.sum("delay_sum").alias("s"), F.sum("trip_count").alias("trip_count"))
    return sums.select(
        "zone_id", "hour", "feed_id", F.try_divide("s", "trip_count").alias("mean_delay"), "trip_count"
    )


def stop_delays(delays: DataFrame, hour: Column) -> DataFrame:
    """Delay sum and count per stop, hour and feed: what is left to join once raw rows are added up."""
    return delays.groupBy("stop_id", hour.alias("hour"), F.col("feed_id").cast("string").alias("feed_id")).agg(
        F.sum("delay").alias("delay_sum"), F.count("delay").alias("trip_count")
    )


def recent_delay(delays: DataFrame, zones: DataFrame, as_of: Column) -> DataFrame:
    """Count-weighted mean delay of the hour before ``as_of`` per zone, else 0.0."""
    weighted = F.try_divide(F.sum(F.col("mean_delay") * F.col("trip_count")), F.sum("trip_count"))
    recent = (
        delays.filter(F.col("hour") > as_of - F.expr("interval 1 hour"))
        .groupBy("zone_id")
        .agg(weighted.alias("_delay"))
    )
    return zones.select("zone_id").distinct().join(recent, "zone_id", "left").select(
        "zone_id", F.coalesce("_delay", F.lit(0.0)).alias("recent_delay")
    )


def standard_columns(congestion: DataFrame) -> DataFrame:
    """Accept legacy tables: ``delay_index`` as the value, no sample counts."""
    if "travel_time_var" not in congestion.columns:
        if "delay_index" not in congestion.columns:
            raise ValueError("congestion needs travel_time_var or delay_index")
        congestion = congestion.withColumn("travel_time_var", F.col("delay_index"))
    if "sample_count" not in congestion.columns:
        congestion = congestion.withColumn("sample_count", F.lit(0))
    return congestion


def congestion_features(congestion: DataFrame, key: str = "zone_id") -> DataFrame:
    """Lag, rolling mean, confidence and trailing disruption flag per zone.

    The flag is 1 when the value exceeds the mean plus two sample deviations of
    the previous 168 rows, and null until there are that many.
    """
    w = win.series(key)
    trailing = win.add_trailing(
        standard_columns(congestion), key, "travel_time_var", FLAG_ROWS, "_mean", "_spread"
    )
    return (
        trailing.withColumns(
            {
                "delay_index_lag1": F.lag("travel_time_var", 1).over(w),
                "delay_index_rolling3h": win.full_mean("travel_time_var", 3, w),
                "low_confidence_flag": low_confidence(F.col("sample_count")),
            }
        )
        .withColumn(
            "disruption_flag",
            (
                F.col("travel_time_var")
                > F.col("_mean") + F.lit(FLAG_SIGMAS) * F.coalesce("_spread", F.lit(0.0))
            ).cast("byte"),
        )
        .drop("_mean", "_spread")
    )


def join_zones(demand: DataFrame, routes: DataFrame) -> DataFrame:
    """Attach the two zones of each route; rows of unknown routes are dropped."""
    return demand.join(
        routes.select("route_id", "origin_zone_id", "destination_zone_id"), "route_id"
    )


def join_congestion(demand: DataFrame, congestion: DataFrame) -> DataFrame:
    """Congestion columns of the origin (``origin_``) and the destination (``dest_``).

    ``congestion`` has one row per zone and hour, so the row count is kept. Call
    it while the demand table is still narrow: if the zone table is too big to
    be sent around, each join moves the demand rows once.
    """
    values = [c for c in congestion.columns if c not in ("zone_id", "hour")]
    for prefix, zone in (("origin", "origin_zone_id"), ("dest", "destination_zone_id")):
        side = congestion.select(
            F.col("zone_id").alias(zone),
            "hour",
            *[F.col(c).alias(f"{prefix}_{c}") for c in values],
        )
        demand = demand.join(side, [zone, "hour"], "left")
    return demand
