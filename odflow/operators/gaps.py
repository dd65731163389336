"""Ranges of hours without observations, per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflow.functions.scalars import hour_of


def gap_ranges(observed: DataFrame, key: str, span: DataFrame | None = None, ts: str = "hour") -> DataFrame:
    """``(key, start, end, hours)``: each run of hours that ``key`` lacks, both ends inclusive.

    Runs lie between a key's first and last hour, or within ``span``, one row (start, end) of timestamps, which
    then bounds all keys that occur in ``observed``. Rows are reduced to distinct hours on the map side before the
    window, so a key has at most one row there for each hour of the calendar. No list of all hours is built: a gap is
    what lies between two neighbouring hours. Rows without a key or time are left out.
    """
    hours = observed.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, hour_of(F.col(ts)).alias("_hour")
    ).distinct()
    one = F.expr("interval 1 hour")
    if span is not None:
        first, last = hour_of(span.agg(F.min("start")).scalar()), hour_of(span.agg(F.max("end")).scalar())
        # the hours just outside the span stand at both ends of each key
        keys = hours.select(key).distinct()
        ends = keys.select(key, F.explode(F.array(first - one, last + one)).alias("_hour"))
        hours = hours.filter(F.col("_hour").between(first, last)).unionByName(ends)
    before = F.lag("_hour").over(Window.partitionBy(key).orderBy("_hour"))
    missing = F.timestamp_diff("HOUR", F.col("_before"), F.col("_hour")) - 1
    return (
        hours.withColumn("_before", before)
        .withColumn("hours", missing)
        .filter(F.col("hours") > 0)
        .select(key, (F.col("_before") + one).alias("start"), (F.col("_hour") - one).alias("end"), "hours")
    )


def gap_days(gaps: DataFrame, least: int = 1) -> DataFrame:
    """Distinct ``day`` of the gaps of at least ``least`` hours."""
    days = F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))
    return gaps.filter(F.col("hours") >= least).select(F.explode(days).alias("day")).distinct()
