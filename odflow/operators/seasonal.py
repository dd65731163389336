"""Seasonal baseline: daily and weekly profiles on a straight trend, all routes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions import windows as win


def hour_of_week(ts):
    return F.weekday(ts) * 24 + F.hour(ts)


def decompose(demand: DataFrame, week_rows: int = 168) -> DataFrame:
    """Add ``trend`` (centred weekly mean) and ``detrended``; the ends stay null.

    Whole-number volumes take the difference of two running totals, which is exact
    and constant work per row; other volumes take a sliding frame.
    """
    half = week_rows // 2
    w = win.series("route_id")
    if win.is_integral(demand, "volume"):
        demand = win.running_totals(demand, "volume", w)

        def inside(total: str):
            return F.lead(total, half - 1).over(w) - F.coalesce(F.lag(total, half + 1).over(w), F.lit(0))

        trend = F.when(inside("_n") == week_rows, inside("_sum") / F.lit(week_rows))
    else:
        frame = w.rowsBetween(-half, half - 1)
        trend = F.when(F.count("volume").over(frame) == week_rows, F.avg("volume").over(frame))
    return (
        demand.withColumn("trend", trend)
        .withColumn("detrended", F.col("volume") - F.col("trend"))
        .drop("_sum", "_n")
    )


def seasonal_forecast(demand: DataFrame, horizon: int = 168, week_rows: int = 168) -> DataFrame:
    """``(route_id, hour, forecast)`` for the ``horizon`` hours after each route's last row.

    Daily effect: mean detrended value per hour of day. Weekly effect: mean of
    what remains per hour of week. Trend: least squares line through the
    centred means over the hours since the first row. Each is one aggregate
    per route, so nothing larger than a profile is ever joined.
    """
    parts = decompose(demand, week_rows).select("route_id", "hour", "trend", "detrended")
    first = Window.partitionBy("route_id")
    parts = parts.withColumn(
        "x",
        (F.timestamp_diff("HOUR", F.min("hour").over(first), F.col("hour"))).cast("double"),
    )
    daily = parts.groupBy("route_id", F.hour("hour").alias("hod")).agg(
        F.avg("detrended").alias("daily")
    )
    # The weekly effect is the mean of (detrended - daily); within one hour of
    # week the daily effect is constant, so it can be subtracted afterwards.
    weekly = parts.groupBy("route_id", hour_of_week(F.col("hour")).alias("how")).agg(
        F.avg("detrended").alias("week_mean")
    )
    lines = parts.groupBy("route_id").agg(
        F.regr_slope("trend", "x").alias("slope"),
        F.regr_intercept("trend", "x").alias("intercept"),
        F.max("hour").alias("last_hour"),
        F.max("x").alias("last_x"),
    )
    steps = lines.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "hour", F.col("last_hour") + F.make_dt_interval(F.lit(0), F.col("step"))
    )
    return (
        steps.withColumns({"hod": F.hour("hour"), "how": hour_of_week(F.col("hour"))})
        .join(daily, ["route_id", "hod"], "left")
        .join(weekly, ["route_id", "how"], "left")
        .select(
            "route_id",
            "hour",
            (
                F.col("intercept")
                + F.col("slope") * (F.col("last_x") + F.col("step"))
                + F.coalesce("week_mean", "daily", F.lit(0.0))
            ).alias("forecast"),
        )
    )
