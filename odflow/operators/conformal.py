"""Split-conformal intervals: forecasts widened by what held-out forecasts missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.session import small_side

# Nominal share of observations between p10 and p90, and the days ahead that are told apart.
COVERAGE = 0.8
LONGEST_DAYS = 7
#: Horizon of the margin over all rows, used where a horizon has none of its own.
ALL = 0
# Rank accuracy of the sketch that brackets a margin; smaller groups are ordered whole.
ACCURACY = 10_000


def days_ahead(hour: Column, first: Column, longest: int = LONGEST_DAYS) -> Column:
    """1 for the first 24 hours from ``first`` on, and so on up to ``longest``."""
    hours = F.floor((F.unix_timestamp(hour.cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))) / 3600)
    return F.least(F.floor(hours / 24) + 1, F.lit(longest)).cast("int")


def conformity(actual: Column) -> Column:
    """How far an observation lies outside its interval; negative inside."""
    return F.greatest(F.col("p10") - actual, actual - F.col("p90"))


def scores(forecasts: DataFrame, actual: str = "volume") -> DataFrame:
    """``(horizon, score)`` of held-out forecasts with ``horizon``, each also under the horizon ALL."""
    both = F.array(F.col("horizon").cast("int"), F.lit(ALL))
    return forecasts.select(F.explode(both).alias("horizon"), conformity(F.col(actual)).cast("double").alias("score"))


def margins(scored: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``(horizon, n, margin)``: the score of rank ceil((n + 1) * coverage) among the n of each horizon.

    The rank with one row more is what makes the guarantee hold for finite samples; it is null
    where the horizon has too few rows for it. Scores are not gathered by horizon: a sketch brackets the
    rank, rows outside the bracket are only counted, on the map side, and equal scores are one row.
    """
    sound = scored.filter(F.col("horizon").isNotNull() & F.col("score").isNotNull())
    slack = 8.0 / ACCURACY
    bounds = [max(0.0, coverage - slack), min(1.0, coverage + slack)]
    stats = sound.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("score", bounds, ACCURACY).alias("q"),
        F.min("score").alias("least"),
        F.max("score").alias("most"),
    )
    few = F.col("n") <= ACCURACY
    stats = small_side(
        stats.select(
            "horizon",
            "n",
            F.ceil(F.round((F.col("n") + 1) * F.lit(coverage), 9)).alias("k"),
            F.when(few | F.lit(bounds[0] == 0.0), F.col("least")).otherwise(F.col("q")[0]).alias("low"),
            F.when(few | F.lit(bounds[1] == 1.0), F.col("most")).otherwise(F.col("q")[1]).alias("high"),
        )
    )
    inside = F.when(F.col("score") >= F.col("low"), F.col("score"))
    counts = (
        sound.join(stats, "horizon")
        .filter(F.col("score") <= F.col("high"))
        .groupBy("horizon", "n", "k", inside.alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # nulls, the rows below the bracket, come first
    upto = F.sum("c").over(Window.partitionBy("horizon").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = (F.col("k") > F.col("upto") - F.col("c")) & (F.col("k") <= F.col("upto"))
    missed = F.raise_error(F.lit("a margin lies outside its bracket")).cast("double")
    found = counts.withColumn("upto", upto).groupBy("horizon", "n", "k").agg(F.max(F.when(hit, F.col("v"))).alias("v"))
    return found.select("horizon", "n", F.when(F.col("k") <= F.col("n"), F.coalesce("v", missed)).alias("margin"))


def calibrate(forecasts: DataFrame, margins: DataFrame, floor: float | None = 0.0) -> DataFrame:
    """p10 and p90 of forecasts with ``horizon`` moved outwards by its margin (inwards if that is negative).

    A horizon without a margin takes that of ALL, and without that the interval stays. The median
    stays inside the interval; p10 does not fall below ``floor``, as counts cannot.
    """
    own = small_side(margins.select("horizon", F.col("margin").alias("_own")))
    rest = margins.filter(F.col("horizon") == ALL).agg(F.max("margin")).scalar()
    margin = F.coalesce("_own", rest, F.lit(0.0))
    low = F.least("p50", F.col("p10") - margin)
    low = low if floor is None else F.least("p50", F.greatest(F.lit(floor), low))
    columns = forecasts.columns
    moved = {"p10": low, "p90": F.greatest("p50", F.col("p90") + margin)}
    return forecasts.join(own, "horizon", "left").withColumns(moved).select(*columns)


def write_calibration(observed: DataFrame, margins: DataFrame, path: str) -> None:
    """Store the calibration table of :func:`validation.calibration` as one JSON record, and the margins as Parquet.

    The record has the lists ``nominal`` and ``observed``, in the order of the levels.
    """
    ordered = F.array_sort(F.collect_list(F.struct("nominal", "observed")))
    record = observed.agg(ordered.alias("r")).select(F.col("r.nominal").alias("nominal"), F.col("r.observed").alias("observed"))
    record.coalesce(1).write.mode("overwrite").json(f"{path}/calibration")
    margins.write.mode("overwrite").parquet(f"{path}/margins")
