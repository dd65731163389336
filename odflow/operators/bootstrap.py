"""Is one forecast better than another? Paired block bootstrap of their losses by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.operators.validation import QUANTILES, pinball

REPLICATES = 1000
# Chances that a Poisson variable of mean 1 is at most 0, 1, ... 9; a draw beyond them counts 10.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887, 0.99999989]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the texts of ``parts`` only."""
    digest = F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def poisson(u: Column) -> Column:
    """How often a row is drawn, for a uniform number ``u``."""
    draw = F.lit(0)
    for limit in POISSON:
        draw = draw + (u >= F.lit(limit)).cast("int")
    return draw


def daily_differences(left: DataFrame, right: DataFrame, actual: str = "volume") -> DataFrame:
    """``(metric, day, difference, n)``: sums over a day of the pinball loss of ``left`` less that of ``right``.

    Both hold stored forecasts p10, p50, p90 by ``route_id`` and ``hour``; the observed value is taken from
    ``left``. Rows of one side alone, or with a null, are left out.
    """
    keys = ["route_id", "hour"]
    other = right.select(*keys, *[F.col(name).alias(f"_{name}") for name in QUANTILES])
    both = left.select(*keys, actual, *QUANTILES).join(other, keys)
    y = F.col(actual)
    gaps = [
        F.struct(F.lit(n).alias("metric"), (pinball(y, F.col(n), q) - pinball(y, F.col(f"_{n}"), q)).alias("gap"))
        for n, q in QUANTILES.items()
    ]
    rows = both.select(F.col("hour").cast("date").alias("day"), F.inline(F.array(*gaps)))
    return rows.filter(F.col("gap").isNotNull()).groupBy("metric", "day").agg(F.sum("gap").alias("difference"), F.count(F.lit(1)).alias("n"))


def replicate_means(daily: DataFrame, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """``(metric, replicate, mean)``: the mean difference with each day drawn a Poisson number of times.

    A day is drawn whole, for all routes and levels, as its hours and routes err together. The draw depends on seed, day and
    replicate alone, so it needs no numbering and repeats agree however the table is split. Only the daily
    sums are copied: days times replicates rows, added up on the map side.
    """
    drawn = daily.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    times = poisson(uniform(F.lit(seed), F.date_format("day", "yyyy-MM-dd"), F.col("replicate")))
    sums = drawn.withColumn("_times", times).filter("_times > 0").groupBy("metric", "replicate").agg(
        F.sum(F.col("_times") * F.col("difference")).alias("_sum"), F.sum(F.col("_times") * F.col("n")).alias("_n")
    )
    return sums.select("metric", "replicate", (F.col("_sum") / F.col("_n")).alias("mean"))


def loss_difference(
    left: DataFrame, right: DataFrame, level: float = 0.95, replicates: int = REPLICATES, seed: int = 0, actual: str = "volume"
) -> DataFrame:
    """``(metric, days, rows, mean, low, high, real)`` of the loss of ``left`` less that of ``right``.

    ``low`` and ``high`` bound the middle ``level`` of the replicates, and ``real`` says that 0 lies outside. The
    replicates are a stated number, so their exact quantiles are cheap.
    """
    daily = daily_differences(left, right, actual)
    whole = daily.groupBy("metric").agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("rows"), (F.sum("difference") / F.sum("n")).alias("mean")
    )
    tail = (1.0 - level) / 2.0
    bounds = replicate_means(daily, replicates, seed).groupBy("metric").agg(
        F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1.0 - tail)).alias("high")
    )
    return whole.join(bounds, "metric", "left").withColumn("real", (F.col("low") > 0) | (F.col("high") < 0))
