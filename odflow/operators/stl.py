"""Seasonal-trend decomposition by local lines, all routes at once.

A series is ``volume = season + trend + rest``. Both parts come from lines fitted locally with tricube weights: the
season across weeks at the same hour of the week, the trend across hours. They are refined in turns, and rows far
from both then count less (robustness weights).

No window slides over a series. A row is copied to the few anchors it is near enough to count for, and a line is five
sums per anchor, which combine on the map side; between anchors the fit is interpolated. The work is linear in rows:
at most ``2 * half / step`` copies of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.session import materialise

WEEK = 168
# Rows of one hour of the week are smoothed over the weeks less than this many away.
SEASON_WEEKS = 5
# Hours on each side that count for the trend, and hours between two anchors.
TREND_HOURS = 2 * WEEK
TREND_STEP = 24
SINGULAR = 1e-9


def hour_number(ts: Column) -> Column:
    """Whole hours since 1970."""
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / 3600)


def local_lines(
    points: DataFrame, keys: list[str], x: str, value: str, half: int, step: int = 1, weight: str | None = None
) -> DataFrame:
    """``(*keys, anchor, line)``: the weighted local line of ``value`` over whole ``x`` at ``x = anchor * step``.

    Anchors are those with a row less than ``half`` away. Where all rows of an anchor share one ``x``, the
    line is their weighted mean. Rows with a null value count for nothing.
    """
    first, last = F.ceil((F.col(x) - (half - 1)) / step), F.floor((F.col(x) + (half - 1)) / step)
    near = points.filter(F.col(value).isNotNull()).select(
        *keys, x, F.col(value).cast("double").alias("_v"),
        (F.col(weight) if weight else F.lit(1.0)).alias("_w"), F.explode(F.sequence(first, last)).alias("anchor"),
    )
    near = near.withColumn("_d", (F.col(x) - F.col("anchor") * step) / F.lit(float(half)))
    near = near.withColumn("_k", F.col("_w") * F.pow(1 - F.pow(F.abs("_d"), F.lit(3)), F.lit(3)))
    k, d, v = F.col("_k"), F.col("_d"), F.col("_v")
    sums = near.groupBy(*keys, "anchor").agg(
        F.sum(k).alias("s0"), F.sum(k * d).alias("s1"), F.sum(k * d * d).alias("s2"),
        F.sum(k * v).alias("t0"), F.sum(k * d * v).alias("t1"),
    )
    spread = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = F.when(
        spread > SINGULAR * F.col("s0") * F.col("s0"), (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / spread
    ).otherwise(F.try_divide(F.col("t0"), F.col("s0")))
    return sums.select(*keys, "anchor", line.alias("line"))


def smooth(
    df: DataFrame, key: str, x: str, value: str, half: int, step: int, out: str, weight: str | None = None
) -> DataFrame:
    """Add ``out``, the local line of ``value`` at each row, interpolated between the two anchors around it."""
    if half <= step:
        raise ValueError("anchors must lie closer than the rows that count for them")
    w = Window.partitionBy(key).orderBy("anchor")
    ends = local_lines(df, [key], x, value, half, step, weight).select(
        key, F.col("anchor").alias("_bin"), F.col("line").alias("_from"), F.lead("line").over(w).alias("_to")
    )
    place = (F.col(x) - F.col("_bin") * step) / F.lit(float(step))
    return (
        df.withColumn("_bin", F.floor(F.col(x) / step))
        .join(ends, [key, "_bin"], "left")
        .withColumn(out, F.col("_from") + (F.col("_to") - F.col("_from")) * place)
        .drop("_bin", "_from", "_to")
    )


def seasonal_part(df: DataFrame, value: str, period: int, cycles: int, weight: str | None) -> DataFrame:
    """``(route_id, x, season)`` for every hour of the cycles of ``df``.

    The lines across cycles are taken one cycle beyond both ends, so that the mean over a whole cycle, which
    is what they share with the trend, exists at every row. That mean is smoothed and taken off.
    """
    phased = df.withColumns({"_phase": F.pmod(F.col("x"), F.lit(period)), "_cycle": F.floor(F.col("x") / period)})
    lines = local_lines(phased, ["route_id", "_phase"], "_cycle", value, cycles, 1, weight)
    ends = phased.groupBy("route_id").agg(F.min("_cycle").alias("_first"), F.max("_cycle").alias("_last"))
    cycle = (
        lines.join(ends, "route_id")
        .filter(F.col("anchor").between(F.col("_first") - 1, F.col("_last") + 1))
        .select("route_id", (F.col("anchor") * period + F.col("_phase")).alias("x"), F.col("line").alias("_cycle_fit"))
    )
    around = Window.partitionBy("route_id").orderBy("x").rangeBetween(-(period // 2), period - period // 2 - 1)
    level = cycle.withColumn("_level", F.avg("_cycle_fit").over(around))
    low = smooth(level, "route_id", "x", "_level", period, max(1, period // 7), "_low")
    return low.select("route_id", "x", (F.col("_cycle_fit") - F.col("_low")).alias("season"))


def one_pass(
    df: DataFrame, trend: str, period: int, cycles: int, half: int, step: int, weight: str | None = None
) -> DataFrame:
    """Season of what ``trend`` leaves, then the trend of what the season leaves."""
    flat = df.withColumn("_flat", F.col("volume") - F.col(trend))
    seasons = seasonal_part(flat, "_flat", period, cycles, weight)
    parted = df.drop("season").join(seasons, ["route_id", "x"], "left")
    parted = parted.withColumn("_level", F.col("volume") - F.col("season")).drop("trend")
    return smooth(parted, "route_id", "x", "_level", half, step, "trend", weight).drop("_level")


def robustness(parts: DataFrame) -> DataFrame:
    """Add ``weight``: ``1 / (1 + u^2)^2`` for the rest ``u`` in units of six times its route's median size.

    It falls with the fourth power of ``u`` but never to zero, so that where an outlier has pulled a whole phase
    away, the outlier still counts least and the next round sets the phase right.
    """
    size = F.abs(F.col("volume") - F.col("season") - F.col("trend"))
    scale = parts.groupBy("route_id").agg((6 * F.percentile_approx(size, F.lit(0.5), F.lit(10_000))).alias("_scale"))
    u = F.when(F.col("_scale") > 0, size / F.col("_scale")).otherwise(F.lit(0.0))
    weight = F.pow(1 + u * u, F.lit(-2))
    return parts.join(scale, "route_id").withColumn("weight", F.coalesce(weight, F.lit(1.0))).drop("_scale")


def stl(
    demand: DataFrame,
    period: int = WEEK,
    cycles: int = SEASON_WEEKS,
    half: int = TREND_HOURS,
    step: int = TREND_STEP,
    inner: int = 1,
    outer: int = 3,
) -> DataFrame:
    """``(route_id, hour, volume, season, trend, remainder, weight)`` of every row with an hour and a volume.

    ``inner`` turns between season and trend, then again for each of the ``outer`` rounds of robustness weights.
    Hours may be missing. Each turn is written, as the next reads it several times.
    """
    parts = demand.filter(F.col("hour").isNotNull() & F.col("volume").isNotNull()).select(
        "route_id", "hour", F.col("volume").cast("double").alias("volume"), hour_number(F.col("hour")).alias("x"),
        F.lit(0.0).alias("trend"), F.lit(1.0).alias("weight"),
    )
    parts = materialise(parts, "series")
    for round_ in range(outer + 1):
        if round_:
            parts = materialise(robustness(parts.drop("weight")), "weights")
        for _ in range(inner):
            parts = materialise(one_pass(parts, "trend", period, cycles, half, step, "weight"), "parts")
    rest = F.col("volume") - F.col("season") - F.col("trend")
    return parts.select("route_id", "hour", "volume", "season", "trend", rest.alias("remainder"), "weight")


def season_worth(parts: DataFrame, period: int = WEEK) -> DataFrame:
    """``(route_id, worth)``: how far the same hour of other periods foretells an hour, from 0 to 1.

    The slope, by the rows' weights, of what the trend leaves of a row on the mean of that over the other rows of its
    phase. A stable season gives about 1, chance patterns, which any smoother also finds, about 0; so does
    a route without repeated phases.
    """
    flat = parts.select(
        "route_id", F.pmod(hour_number(F.col("hour")), F.lit(period)).alias("_phase"), "weight",
        (F.col("volume") - F.col("trend")).alias("_flat"),
    )
    w, v = F.col("weight"), F.col("_flat")
    sums = flat.groupBy("route_id", "_phase").agg(
        F.sum(w * v).alias("_sum"), F.sum(w).alias("_all"), F.count(v).alias("_n")
    )
    others = flat.join(sums, ["route_id", "_phase"]).withColumn(
        "_others", F.try_divide(F.col("_sum") - w * v, F.col("_all") - w)
    )
    o = F.when(F.col("_n") > 1, F.col("_others"))
    slope = others.groupBy("route_id").agg(F.try_divide(F.sum(w * o * v), F.sum(w * o * o)).alias("_slope"))
    return slope.select("route_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("_slope", F.lit(0.0)))).alias("worth"))


def stl_forecast(parts: DataFrame, horizon: int = WEEK, period: int = WEEK) -> DataFrame:
    """``(route_id, hour, forecast)`` for the ``horizon`` hours after each route's last row.

    The last trend goes on level, with the latest season of the same hour of the period, as far as that
    season is worth. An hour of the period that a route never had takes the trend alone.
    """
    phased = parts.withColumn("_phase", F.pmod(hour_number(F.col("hour")), F.lit(period)))
    latest = phased.groupBy("route_id", "_phase").agg(F.max_by("season", "hour").alias("_season"))
    last = parts.groupBy("route_id").agg(F.max("hour").alias("_last"), F.max_by("trend", "hour").alias("_trend"))
    last = last.join(season_worth(parts, period), "route_id", "left")
    steps = last.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "hour", F.col("_last") + F.make_dt_interval(F.lit(0), F.col("_step"))
    )
    steps = steps.withColumn("_phase", F.pmod(hour_number(F.col("hour")), F.lit(period)))
    season = F.coalesce(F.col("worth") * F.col("_season"), F.lit(0.0))
    return steps.join(latest, ["route_id", "_phase"], "left").select(
        "route_id", "hour", (F.col("_trend") + season).alias("forecast")
    )
