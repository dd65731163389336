"""Trips to hourly demand, and the demand and duration features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.functions import windows as win
from odflow.session import materialise
from odflow.functions.scalars import hour_of, with_trip_seconds

PAIR_HOUR = ["PULocationID", "DOLocationID", "hour"]

# Row offsets and window lengths of the training features.
DEMAND_LAGS = [1, 2, 3, 24, 48, 72, 96, 120, 144, 168]
DEMAND_WINDOWS = [3, 24, 168, 336]
WEEK = 168
TREND_SPAN = 24
YEAR_ROWS = 8760
RATIO_RANGE = (0.01, 100.0)
DURATION_LAGS = [1, 24, 168]
DURATION_WINDOWS = [3, 24]
ROUTE_THRESHOLD = 1000


def _timed(trips: DataFrame) -> DataFrame:
    return with_trip_seconds(trips).withColumns(
        {
            "hour": hour_of(F.col("pickup_datetime")),
            "PULocationID": F.col("PULocationID").cast("long"),
            "DOLocationID": F.col("DOLocationID").cast("long"),
        }
    )


def hourly_pairs(trips: DataFrame) -> DataFrame:
    """Trip count and mean duration per pair and hour."""
    return _timed(trips).groupBy(*PAIR_HOUR).agg(
        F.count(F.lit(1)).alias("pickup_count"), F.avg("duration").alias("avg_duration")
    )


def _mean_of_present(values: list[Column]) -> Column:
    known = [F.when(v.isNotNull(), 1).otherwise(0) for v in values]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.try_divide(total, sum(known, F.lit(0)))


def combined_pairs(trips: DataFrame, colors: list[str], weighted: bool = False) -> DataFrame:
    """Hourly pairs over all colours: counts add up, mean durations are averaged.

    The mean is the plain mean of the per-colour means (a file is one colour of
    one month, and the hour fixes the month); ``weighted=True`` gives the mean
    over trips. The colours are known beforehand, so one aggregation holds a
    mean per colour and the trips are shuffled once, already pre-aggregated.
    """
    timed = _timed(trips)
    count = F.count(F.lit(1)).alias("pickup_count")
    if weighted:
        return timed.groupBy(*PAIR_HOUR).agg(count, F.avg("duration").alias("avg_duration"))
    names = [f"_mean_{i}" for i in range(len(colors))]
    means = [
        F.avg(F.when(F.col("color") == color, F.col("duration"))).alias(name)
        for color, name in zip(colors, names)
    ]
    return (
        timed.filter(F.col("color").isin(colors))
        .groupBy(*PAIR_HOUR)
        .agg(count, *means)
        .withColumn("avg_duration", _mean_of_present([F.col(n) for n in names]))
        .drop(*names)
    )


def selected_routes(trips: DataFrame, threshold: float = ROUTE_THRESHOLD) -> DataFrame:
    """Pairs with more than ``threshold`` trips per month, over the months with data.

    Trips are read once, into counts by pair and month; these are written, and both the
    totals and the number of months come from them.
    """
    month = F.trunc(F.col("pickup_datetime").cast("date"), "month").alias("m")
    monthly = materialise(
        trips.groupBy("PULocationID", "DOLocationID", month).agg(F.count(F.lit(1)).alias("n")), "monthly"
    )
    months = monthly.select("m").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        monthly.groupBy("PULocationID", "DOLocationID")
        .agg(F.sum("n").alias("trips"))
        .withColumn("avg_monthly_volume", F.col("trips") / months)
        .filter(F.col("avg_monthly_volume") > threshold)
    )


def resolve_routes(hourly: DataFrame, routes: DataFrame) -> DataFrame:
    """Attach ``route_id`` to hourly pairs; unknown pairs are dropped."""
    named = routes.select(
        "route_id",
        F.col("origin_zone_id").alias("PULocationID"),
        F.col("destination_zone_id").alias("DOLocationID"),
    )
    return hourly.join(named, ["PULocationID", "DOLocationID"])


def _lags(value: str, rows: list[int], prefix: str, w) -> dict[str, Column]:
    return {f"{prefix}lag_{n}h": F.lag(value, n).over(w) for n in rows}


def demand_features(demand: DataFrame, year_rows: int = YEAR_ROWS, key: str = "route_id") -> DataFrame:
    """Lags, rolling means, trend and year-over-year ratio of ``volume``.

    One exchange on the key serves every feature. ``year_rows`` is the row
    offset of "one year ago".
    """
    whole = win.is_integral(demand, "volume")
    if not whole:
        demand = win.add_trailing(demand, key, "volume", WEEK, "_week_mean")
    blocked = win.add_block(demand, key, TREND_SPAN)
    w = win.series(key).orderBy("_block", "hour")
    if whole:
        blocked = win.running_totals(blocked, "volume", w)
        means = {f"rolling_mean_{n}h": win.full_mean_from_totals(n, w) for n in DEMAND_WINDOWS}
    else:
        week = F.col("_week_mean")
        means = {
            **{f"rolling_mean_{n}h": win.full_mean("volume", n, w) for n in DEMAND_WINDOWS if n < WEEK},
            f"rolling_mean_{WEEK}h": week,
            f"rolling_mean_{2 * WEEK}h": (week + F.lag(week, WEEK).over(w)) / 2,
        }
    trended = win.add_ewm(blocked, key, "volume", TREND_SPAN, "_trend")
    year_ago = F.lag("volume", year_rows).over(w)
    return (
        trended.withColumns(
            {
                **_lags("volume", DEMAND_LAGS, "", w),
                **means,
                "ewm_trend_24h": F.lag("_trend", 1).over(w),
                "_year_ago": year_ago,
            }
        )
        .withColumn("yoy_ratio", bounded_ratio(F.col("volume"), F.col("_year_ago")))
        .drop("_row", "_block", "_sum", "_n", "_week_mean", "_trend", "_year_ago")
    )


def bounded_ratio(now: Column, before: Column) -> Column:
    """``now / max(before, 0.001)`` kept inside the ratio range; null if either is."""
    low, high = RATIO_RANGE
    ratio = now / F.greatest(before.cast("double"), F.lit(1e-3))
    return F.when(
        now.isNotNull() & before.isNotNull(), F.least(F.greatest(ratio, F.lit(low)), F.lit(high))
    )


def duration_features(demand: DataFrame, key: str = "route_id") -> DataFrame:
    """Lags and rolling means of ``avg_duration``; unchanged if there is no such column."""
    if "avg_duration" not in demand.columns:
        return demand
    w = win.series(key)
    return demand.withColumns(
        {
            **_lags("avg_duration", DURATION_LAGS, "duration_", w),
            **{
                f"duration_rolling_mean_{n}h": win.full_mean("avg_duration", n, w)
                for n in DURATION_WINDOWS
            },
        }
    )
