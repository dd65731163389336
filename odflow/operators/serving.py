"""Features at forecast time, for all routes in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.calendar import serving_calendar
from odflow.functions.scalars import LOW_CONFIDENCE_SAMPLES

# Fixed values.
HISTORY_ROWS = 168
LAGS = [1, 2, 3, 6, 12, 24, 48, 72, 96, 120, 144, 168]
WINDOWS = [3, 6, 12, 24, 48, 72, 168]
TREND_SPANS = [24, 168]
DURATION_LAGS = [1, 24, 168]
DURATION_WINDOWS = [3, 24]
CALENDAR = [
    "hour_of_day",
    "dow",
    "month",
    "week_of_year",
    "is_weekend",
    "days_to_next_us_holiday",
    "nyc_event_flag",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "month_sin",
    "month_cos",
]
ZONE_FEATURES = [
    "delay_index_lag1",
    "delay_index_lag24",
    "delay_index_rolling3h",
    "disruption_flag",
    "low_confidence_flag",
]
# The order of the 54 slots.
SERVING_FEATURES = (
    ["route_id", "horizon_hours", "origin_delay_index"]
    + CALENDAR
    + [f"lag_{n}h" for n in LAGS]
    + [f"rolling_mean_{n}h" for n in WINDOWS]
    + [f"ewm_trend_{n}h" for n in TREND_SPANS]
    + ["yoy_ratio", "dest_delay_index"]
    + [f"origin_{c}" for c in ZONE_FEATURES]
    + [f"dest_{c}" for c in ZONE_FEATURES]
    + [f"duration_lag_{n}h" for n in DURATION_LAGS]
    + [f"duration_rolling_mean_{n}h" for n in DURATION_WINDOWS]
)


def newest(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` newest rows per key, numbered from 1 as ``rn``.

    The rank filter is applied before the shuffle as well as after it, so a key
    never sends more than ``rows`` rows per input partition.
    """
    w = Window.partitionBy(key).orderBy(F.desc("hour"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows)


def latest_congestion(congestion: DataFrame, zones: DataFrame) -> DataFrame:
    """Latest value and sample count per zone, (0.0, 0) for a zone without rows."""
    latest = congestion.groupBy("zone_id").agg(
        F.max_by(F.struct("travel_time_var", "sample_count"), "hour").alias("_last")
    )
    return zones.select("zone_id").distinct().join(latest, "zone_id", "left").select(
        "zone_id",
        F.coalesce("_last.travel_time_var", F.lit(0.0)).alias("travel_time_var"),
        F.coalesce("_last.sample_count", F.lit(0)).alias("sample_count"),
    )


def _oldest_first(value: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("rn"), value.alias("v"))))
    return F.transform(ordered, lambda s: s["v"])


def demand_history(demand: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """Arrays of the last volumes and durations per route, oldest first."""
    return newest(demand, "route_id", rows).groupBy("route_id").agg(
        _oldest_first(F.col("volume")).alias("volumes"),
        _oldest_first(F.coalesce("avg_duration", F.lit(0.0))).alias("durations"),
    )


def congestion_history(congestion: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """Array of the last travel-time variances per zone, oldest first."""
    return newest(congestion, "zone_id", rows).groupBy("zone_id").agg(
        _oldest_first(F.col("travel_time_var")).alias("travel_time_vars")
    )


def _at(value: Column, rank: int) -> Column:
    return F.coalesce(F.max(F.when(F.col("rn") == rank, value)), F.lit(0.0))


def _recent_mean(value: Column, rows: int) -> Column:
    """Mean of up to ``rows`` newest values: partial windows count."""
    return F.coalesce(F.avg(F.when(F.col("rn") <= rows, value)), F.lit(0.0))


def _seeded_trend(values: Column, span: int) -> Column:
    alpha = 2.0 / (span + 1.0)
    rest = F.slice(values, F.lit(2), F.size(values))
    return F.aggregate(rest, values[0], lambda acc, v: F.lit(alpha) * v + F.lit(1.0 - alpha) * acc)


def route_state(demand: DataFrame) -> DataFrame:
    """Lags, partial means, trends and duration features of each route's last week."""
    volume = F.col("volume").cast("double")
    duration = F.coalesce("avg_duration", F.lit(0.0))
    aggregates = [
        *[_at(volume, n).alias(f"lag_{n}h") for n in LAGS],
        *[_recent_mean(volume, n).alias(f"rolling_mean_{n}h") for n in WINDOWS],
        *[_at(duration, n).alias(f"duration_lag_{n}h") for n in DURATION_LAGS],
        *[_recent_mean(duration, n).alias(f"duration_rolling_mean_{n}h") for n in DURATION_WINDOWS],
        _oldest_first(volume).alias("_volumes"),
    ]
    state = newest(demand, "route_id", HISTORY_ROWS).groupBy("route_id").agg(*aggregates)
    trends = {f"ewm_trend_{n}h": _seeded_trend(F.col("_volumes"), n) for n in TREND_SPANS}
    return state.withColumns(trends).withColumn("yoy_ratio", F.lit(0.0)).drop("_volumes")


def zone_state(congestion: DataFrame) -> DataFrame:
    """Lags, partial mean and flags of each zone's last week, plus its latest value.

    The disruption flag compares with the population deviation and is 0 for a
    zone with fewer than 168 rows.
    """
    value = F.col("travel_time_var").cast("double")
    enough = F.count(F.lit(1)) >= HISTORY_ROWS
    high = F.max(F.when(F.col("rn") == 1, value)) > F.avg(value) + 2.0 * F.stddev_pop(value)
    samples = F.coalesce(F.max(F.when(F.col("rn") == 1, F.col("sample_count"))), F.lit(0))
    return newest(congestion, "zone_id", HISTORY_ROWS).groupBy("zone_id").agg(
        _at(value, 1).alias("delay_index"),
        _at(value, 1).alias("delay_index_lag1"),
        _at(value, 24).alias("delay_index_lag24"),
        _recent_mean(value, 3).alias("delay_index_rolling3h"),
        F.when(enough & high, 1.0).otherwise(0.0).alias("disruption_flag"),
        F.when(samples < LOW_CONFIDENCE_SAMPLES, 1.0).otherwise(0.0).alias("low_confidence_flag"),
    )


def static_features(routes: DataFrame, demand: DataFrame, congestion: DataFrame) -> DataFrame:
    """The slots that do not depend on the step, one row per route; zeros without history."""
    wide = routes.select("route_id", "origin_zone_id", "destination_zone_id").join(
        route_state(demand), "route_id", "left"
    )
    zones = zone_state(congestion)
    for prefix, zone in (("origin", "origin_zone_id"), ("dest", "destination_zone_id")):
        side = zones.select(
            F.col("zone_id").alias(zone),
            *[F.col(c).alias(f"{prefix}_{c}") for c in zones.columns if c != "zone_id"],
        )
        wide = wide.join(side, zone, "left")
    no_data = {c: 0.0 for c in wide.columns if not c.endswith("_id")}
    no_data.update(origin_low_confidence_flag=1.0, dest_low_confidence_flag=1.0)
    return wide.fillna(no_data)


def horizon_matrix(
    static: DataFrame,
    horizon_hours: Column | int,
    as_of: Column,
    events: DataFrame | None = None,
    single: bool = True,
) -> DataFrame:
    """One row per route and hour ahead, with the 54 slots in their order.

    ``single`` gives the slots (other than the route) in single precision.
    """
    last = F.lit(horizon_hours) if isinstance(horizon_hours, int) else horizon_hours
    steps = static.withColumn("horizon_hours", F.explode(F.sequence(F.lit(1), last))).withColumn(
        "target_hour", as_of + F.make_dt_interval(F.lit(0), F.col("horizon_hours"))
    )
    matrix = serving_calendar(steps, "target_hour", events)
    kind = "float" if single else "double"
    slots = [F.col(c).cast(kind).alias(c) for c in SERVING_FEATURES if c != "route_id"]
    return matrix.select("route_id", *slots)


def training_view(matrix: DataFrame) -> DataFrame:
    """The matrix under the names and conventions the model was trained with.

    Training counts weekdays from 1 and names the current value differently.
    """
    return matrix.withColumnsRenamed(
        {"origin_delay_index": "origin_travel_time_var", "dest_delay_index": "dest_travel_time_var"}
    ).withColumn("dow", F.col("dow") + 1)


def skew_report(
    features: DataFrame, static: DataFrame, columns: list[str]
) -> DataFrame:
    """Per feature: routes compared, differing routes and largest difference."""
    serving = static.select("route_id", *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    joined = features.join(serving, "route_id")
    parts = []
    for c in columns:
        gap = F.abs(F.col(c).cast("double") - F.col(f"_{c}"))
        parts.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(gap).alias("compared"),
                F.count_if(gap > 1e-6).alias("different"),
                F.max(gap).alias("max_abs_diff"),
            ).alias(c)
        )
    summary = joined.agg(*parts)
    return summary.select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def fan_chart(forecast: DataFrame, horizon_days: int) -> DataFrame:
    """The first ``horizon_days`` days of a forecast in long form."""
    return forecast.filter(F.col("step") <= horizon_days * 24).select(
        "route_id", "step", "p10", "p50", "p90"
    )


def headline(forecast: DataFrame) -> DataFrame:
    """First-hour forecast per route."""
    first = F.min_by(F.struct("p10", "p50", "p90"), "step").alias("first")
    return forecast.groupBy("route_id").agg(first).select("route_id", "first.*")
