"""Exploration tables: coverage, correlation, seasonality, distribution, concentration.

Global statistics enter as scalar subqueries: they are computed once and
compared as constants, without joining a one-row table to every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.scalars import time_of_day

# Fixed values.
DAY_NAMES = {0: "Sun", 1: "Mon", 2: "Tue", 3: "Wed", 4: "Thu", 5: "Fri", 6: "Sat"}
SPARSE_ROUTE_ROWS = 500
SPARSE_CELL_VOLUME = 10
SAMPLE_HOURS = 72.0
CONCENTRATED_SHARE = 80.0


def _naive(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def coverage(demand: DataFrame, congestion: DataFrame) -> DataFrame:
    """Demand hours per route and how many of them have a congestion row at the origin."""
    hours = congestion.select(
        F.col("zone_id").alias("origin_zone_id"), "hour", F.lit(1).alias("_match")
    )
    return (
        demand.join(hours, ["origin_zone_id", "hour"], "left")
        .groupBy("route_id")
        .agg(F.count(F.lit(1)).alias("demand_hours"), F.count("_match").alias("matched_hours"))
        .withColumn("coverage_ratio", F.try_divide("matched_hours", "demand_hours"))
    )


def joined_signals(demand: DataFrame, congestion: DataFrame) -> DataFrame:
    """Demand rows with the travel-time variance at their origin in the same hour."""
    values = congestion.filter(F.col("travel_time_var").isNotNull()).select(
        F.col("zone_id").alias("origin_zone_id"), "hour", "travel_time_var"
    )
    return demand.join(values, ["origin_zone_id", "hour"]).select(
        "route_id", "hour", F.col("volume").cast("double").alias("volume"), "travel_time_var"
    )


def correlation(joined: DataFrame) -> DataFrame:
    return joined.agg(F.corr("volume", "travel_time_var").alias("corr"))


def correlation_by_time_of_day(joined: DataFrame) -> DataFrame:
    return joined.groupBy(time_of_day(F.hour("hour")).alias("tod_bucket")).agg(
        F.corr("volume", "travel_time_var").alias("corr")
    )


def correlation_by_route(joined: DataFrame) -> DataFrame:
    """One row per route whose correlation is defined."""
    corr = F.corr("volume", "travel_time_var")
    return (
        joined.groupBy("route_id")
        .agg(F.nullif(corr, F.lit(float("nan"))).alias("correlation"))
        .filter(F.col("correlation").isNotNull())
    )


def lag_correlation(
    demand: DataFrame, congestion: DataFrame, max_lag: int = 6, min_rows: int = 10
) -> DataFrame:
    """Correlation of demand with the congestion ``k`` hours earlier, ``k`` from 0 up.

    All lags are one job: each (narrow) congestion row is repeated per lag with
    its hour moved, then joined and aggregated once.
    """
    moved = congestion.select(
        F.col("zone_id").alias("origin_zone_id"),
        F.col("hour").alias("_at"),
        "travel_time_var",
        F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag_hours"),
    ).withColumn("hour", F.col("_at") + F.make_dt_interval(F.lit(0), F.col("lag_hours")))
    return (
        demand.join(moved, ["origin_zone_id", "hour"])
        .groupBy("lag_hours")
        .agg(
            F.corr(F.col("volume").cast("double"), "travel_time_var").alias("correlation"),
            F.count(F.lit(1)).alias("rows"),
        )
        .filter(F.col("rows") > min_rows)
        .drop("rows")
    )


def hourly_profile(demand: DataFrame) -> DataFrame:
    return demand.groupBy(F.hour("hour").alias("hour_of_day")).agg(
        F.avg("volume").alias("avg_volume")
    )


def weekday_profile(demand: DataFrame) -> DataFrame:
    """Mean volume per weekday, 0 = Sunday, with the day's name."""
    names = F.create_map(*[F.lit(v) for pair in DAY_NAMES.items() for v in pair])
    return (
        demand.groupBy((F.dayofweek("hour") - 1).alias("day_of_week"))
        .agg(F.avg("volume").alias("avg_volume"))
        .withColumn("dow_name", F.element_at(names, F.col("day_of_week")))
    )


def weekly_trend(demand: DataFrame) -> DataFrame:
    """Mean volume per week, weeks starting on Monday."""
    return demand.groupBy(_naive(F.date_trunc("week", "hour")).alias("week_start")).agg(
        F.avg("volume").alias("avg_volume")
    )


def monthly_counts(demand: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows per month, over ``start <= hour < end`` when given."""
    if start:
        demand = demand.filter(F.col("hour") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        demand = demand.filter(F.col("hour") < F.lit(end).cast("timestamp_ntz"))
    return demand.groupBy(_naive(F.date_trunc("month", "hour")).alias("month")).agg(
        F.count(F.lit(1)).alias("count")
    )


def year_overlay(demand: DataFrame) -> DataFrame:
    """Total volume per calendar month and year."""
    return demand.groupBy(F.year("hour").alias("year"), F.month("hour").alias("month")).agg(
        F.sum("volume").alias("total_volume")
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum of a column."""
    return df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )


def exact_quantiles(
    df: DataFrame, column: str, levels: list[float], accuracy: int = 10_000
) -> DataFrame:
    """Linearly interpolated quantiles of all rows, without gathering the column.

    A quantile sketch first brackets every level; its rank error is at most
    ``rows / accuracy``, so the bracket ends four such steps away enclose the two
    order statistics wanted; the counts below and inside a bracket are compared
    with the ranks, and a miss is an error. A second pass counts the rows below
    each bracket on the map side and shuffles only the values inside the brackets.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    margin = 4.0 / accuracy
    lows = [max(0.0, p - margin) for p in levels]
    highs = [min(1.0, p + margin) for p in levels]
    stats = values.agg(
        F.percentile_approx("v", lows + highs, accuracy).alias("q"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.count(F.lit(1)).alias("n"),
    )
    # The end levels must reach the true extremes.
    brackets = [
        F.struct(
            F.lit(i).alias("level"),
            F.lit(p).alias("quantile"),
            F.col("n"),
            (F.col("least") if low == 0.0 else F.col("q")[i]).alias("low"),
            (F.col("most") if high == 1.0 else F.col("q")[len(levels) + i]).alias("high"),
        )
        for i, (p, low, high) in enumerate(zip(levels, lows, highs))
    ]
    bounds = stats.select(F.array(*brackets)).scalar()
    return _order_statistics(values, bounds)


# Slices of a bracket that are ordered apart from each other: equal on a logarithmic scale, so that
# a heavy tail does not leave most values in the first of them.
SLICES = 1024


def _scale(v: Column) -> Column:
    return F.signum(v) * F.log1p(F.abs(v))


def _order_statistics(values: DataFrame, bounds: Column) -> DataFrame:
    inside = F.when(F.col("v") >= F.col("low"), F.col("v"))
    low, high = _scale(F.col("low")), _scale(F.col("high"))
    slice_of = F.floor(F.try_divide(_scale(inside) - low, high - low) * SLICES)
    counts = (
        values.select("v", F.explode(bounds).alias("b"))
        .select("v", "b.*")
        .filter(F.col("v") <= F.col("high"))
        .groupBy(
            "level", "quantile", "n",
            F.when(inside.isNull(), -1).otherwise(F.coalesce(slice_of, F.lit(0))).alias("slice"),
            inside.alias("v"),
        )
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # Slices are numbered as a whole (at most 1,026 per level), values inside their slice.
    earlier = Window.partitionBy("level").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.groupBy("level", "slice")
        .agg(F.sum("c").alias("c"))
        .select("level", "slice", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("level", "slice").orderBy("v")
    upto = F.col("start") + F.sum("c").over(within.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.join(starts, ["level", "slice"]).withColumn("upto", upto)
    place = F.col("quantile") * (F.col("n") - 1)
    below, above = F.floor(place), F.ceil(place)

    def at(rank: Column) -> Column:
        found = F.max(F.when((rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto")), F.col("v")))
        return F.coalesce(found, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))

    return (
        ranked.groupBy("level", "quantile", "n")
        .agg(at(below).alias("a"), at(above).alias("z"))
        .select("quantile", (F.col("a") + (F.col("z") - F.col("a")) * (place - below)).alias("value"))
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal-width bins between minimum and maximum."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    ends = values.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    low = ends.getField("low")
    width = (ends.getField("high") - low) / F.lit(bins)
    place = F.coalesce(F.floor(F.try_divide(F.col("v") - low, width)), F.lit(0))
    return values.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )


def sigma_share(congestion: DataFrame) -> DataFrame:
    """Global limit (mean plus two sample deviations) and the percentage above it."""
    values = congestion.filter(F.col("travel_time_var").isNotNull()).select("travel_time_var")
    limit = values.agg(F.avg("travel_time_var") + 2 * F.stddev_samp("travel_time_var")).scalar()
    return values.agg(
        F.max(limit).alias("sigma_limit"),
        (F.avg((F.col("travel_time_var") > limit).cast("double")) * 100).alias("pct_above"),
    )


def global_flags(congestion: DataFrame) -> DataFrame:
    """1 where the value exceeds the global mean plus two population deviations."""
    values = congestion.filter(F.col("travel_time_var").isNotNull())
    limit = values.agg(F.avg("travel_time_var") + 2 * F.stddev_pop("travel_time_var")).scalar()
    return values.select(
        "zone_id", "hour", (F.col("travel_time_var") > limit).cast("int").alias("disruption_flag")
    )


def _flag_rates(flags: DataFrame, key: Column) -> DataFrame:
    return (
        flags.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("disruption_flag").alias("flag_count"))
        .withColumn("flag_rate", F.col("flag_count") / F.col("rows"))
    )


def flags_by_zone(flags: DataFrame) -> DataFrame:
    return _flag_rates(flags, F.col("zone_id"))


def flags_by_hour(flags: DataFrame) -> DataFrame:
    return _flag_rates(flags, F.hour("hour").alias("hour_of_day"))


def flag_concentration(flags: DataFrame, zones: int = 5) -> DataFrame:
    """Share of all flags in the zones with the highest flag rate."""
    rates = flags_by_zone(flags)
    total = flags.agg(F.sum("disruption_flag")).scalar()
    top = rates.orderBy(F.desc("flag_rate"), "zone_id").limit(zones)
    return top.agg((F.sum("flag_count") / F.nullif(total, F.lit(0)) * 100).alias("share_pct")).select(
        "share_pct", (F.col("share_pct") >= CONCENTRATED_SHARE).alias("concentrated")
    )


def signal_sparsity(congestion: DataFrame, hours: float = SAMPLE_HOURS) -> DataFrame:
    return (
        congestion.groupBy("zone_id")
        .agg(F.count(F.lit(1)).alias("active_hours"))
        .withColumn("coverage_ratio", F.col("active_hours") / F.lit(hours))
    )


def route_strata(demand: DataFrame, min_rows: int = SPARSE_ROUTE_ROWS) -> DataFrame:
    """Observations per route, and whether there are too few to train on."""
    return (
        demand.groupBy("route_id")
        .agg(
            F.count(F.lit(1)).alias("obs"),
            F.count_if(F.col("volume") < SPARSE_CELL_VOLUME).alias("sparse_cells"),
        )
        .withColumn("stratum", F.when(F.col("obs") < min_rows, "sparse").otherwise("dense"))
    )


def route_observations(demand: DataFrame) -> DataFrame:
    return demand.groupBy("route_id").agg(F.count(F.lit(1)).alias("obs"))


def extreme_routes(observations: DataFrame, n: int = 10, busiest: bool = True) -> DataFrame:
    """The ``n`` routes with the most (or fewest) rows."""
    order = F.desc("obs") if busiest else F.asc("obs")
    return observations.orderBy(order, "route_id").limit(n)


def busiest_routes(demand: DataFrame, n: int = 10) -> DataFrame:
    return (
        demand.groupBy("route_id")
        .agg(F.sum("volume").alias("total_volume"))
        .orderBy(F.desc("total_volume"), "route_id")
        .limit(n)
    )


def top_zone_map(volumes: DataFrame, zones: DataFrame, n: int = 10) -> DataFrame:
    """All zones with the volume of the ``n`` busiest; 0 elsewhere."""
    top = (
        volumes.groupBy("zone_id")
        .agg(F.sum("volume").alias("total_volume"))
        .orderBy(F.desc("total_volume"), "zone_id")
        .limit(n)
    )
    return zones.select("zone_id").distinct().join(top, "zone_id", "left").fillna(0, ["total_volume"])


def bounded_sample(df: DataFrame, key: list[str], n: int, seed: str = "0") -> DataFrame:
    """``n`` rows in pseudo-random order; the same rows every time for one seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *key)), *key).limit(n)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and first and last hour of each table."""
    parts = [
        df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.min("hour").alias("min_hour"),
            F.max("hour").alias("max_hour"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
