"""Encoder and decoder windows per route for sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ENCODER_ROWS = 336
HORIZON_ROWS = 168
KNOWN = ["time_idx", "hour_of_day", "dow", "week_of_year", "days_to_next_us_holiday", "nyc_event_flag"]
UNKNOWN = [
    "volume",
    "origin_delay_index_lag1",
    "dest_delay_index_lag1",
    "origin_disruption_flag",
    "dest_disruption_flag",
]


def sequence_windows(
    df: DataFrame,
    encoder: int = ENCODER_ROWS,
    horizon: int = HORIZON_ROWS,
    known: list[str] | None = None,
    unknown: list[str] | None = None,
    last_only: bool = False,
    stride: int = 1,
) -> DataFrame:
    """One row per window end: past rows in ``past``, following rows in ``future``.

    ``past`` holds up to ``encoder`` rows (at least half of that) with known and
    unknown columns, ``future`` up to ``horizon`` rows (at least one) with the
    known columns and the target. ``center`` and ``scale`` are the mean and
    sample deviation of the route's target. Every ``stride``-th end is kept,
    counted back from the newest complete window; ``last_only`` keeps that one
    alone, as used for prediction.

    A route's rows are numbered, and each goes to the blocks of ends that need
    it (three at most), so a window is a slice of its block's array. For
    ``last_only`` no more than ``encoder + horizon`` rows per route get that far.
    """
    known = KNOWN if known is None else known
    unknown = UNKNOWN if unknown is None else unknown
    route = Window.partitionBy("route_id")
    rank, n = F.col("_rank"), F.col("_n")
    first = max(encoder // 2, 1)
    newest = F.greatest(n - horizon, F.lit(first))
    numbered = (
        df.select("route_id", "hour", *dict.fromkeys(["time_idx", *known, *unknown, "volume"]))
        .withColumns(
            {
                "center": F.avg("volume").over(route),
                "scale": F.stddev_samp("volume").over(route),
                "_n": F.count(F.lit(1)).over(route),
                "_rank": F.row_number().over(route.orderBy("time_idx")),
            }
        )
        .filter(n > first)
    )
    size = encoder + horizon
    block = F.col("_block")
    if last_only:
        dealt = numbered.filter(rank.between(newest - (encoder - 1), newest + horizon)).withColumn("_block", F.lit(0))
        ends = F.array(newest)
    else:
        # the ends that need a row lie from ``horizon`` before it to ``encoder - 1`` behind it
        low = F.greatest(F.lit(0), F.floor((rank - horizon - 1) / size))
        high = F.least(F.floor((rank + encoder - 2) / size), F.floor((n - 2) / size))
        dealt = numbered.withColumn("_block", F.explode(F.sequence(low, high)))
        low, high = F.greatest(F.lit(first), block * size + 1), F.least(n - 1, (block + 1) * size)
        ends = F.filter(F.when(low <= high, F.sequence(low, high)), lambda e: F.pmod(newest - e, F.lit(stride)) == 0)
    past = F.struct(*dict.fromkeys([*known, *unknown])).alias("past")
    future = F.struct(*dict.fromkeys([*known, "volume"])).alias("future")
    blocks = dealt.groupBy("route_id", "_block").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "hour", "time_idx", past, future))).alias("_rows"),
        *[F.max(c).alias(c) for c in ("_n", "center", "scale")],
    )
    rows = F.col("_rows")
    at = F.col("_end") - rows[0]["_rank"] + 1
    start = F.greatest(at - (encoder - 1), F.lit(1))
    return (
        blocks.withColumn("_end", F.explode(ends))
        .withColumns({"_at": at.cast("int"), "_start": start.cast("int")})
        .select(
            "route_id",
            rows[F.col("_at") - 1]["hour"].alias("hour"),
            rows[F.col("_at") - 1]["time_idx"].alias("time_idx"),
            "center",
            "scale",
            F.least(F.col("_end"), F.lit(encoder)).cast("long").alias("past_rows"),
            F.least(n - F.col("_end"), F.lit(horizon)).cast("long").alias("future_rows"),
            F.slice(rows, F.col("_start"), F.col("_at") - F.col("_start") + 1)["past"].alias("past"),
            F.slice(rows, F.col("_at") + 1, F.lit(horizon))["future"].alias("future"),
        )
    )
