"""Row-level expressions: durations, buckets, flags and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
LOW_CONFIDENCE_SAMPLES = 10
CONGESTION_BUCKET = 10.0


def trip_seconds(pickup: Column, dropoff: Column) -> Column:
    """Whole seconds of a trip, never below 0; null when an end is missing."""
    seconds = F.timestamp_diff("SECOND", pickup, dropoff)
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0).cast("long")))


def with_trip_seconds(trips: DataFrame, out: str = "duration") -> DataFrame:
    """Add the trip duration; 0.0 when the table lacks one of the two times."""
    if {"pickup_datetime", "dropoff_datetime"} <= set(trips.columns):
        value = trip_seconds(F.col("pickup_datetime"), F.col("dropoff_datetime"))
    else:
        value = F.lit(0.0)
    return trips.withColumn(out, value)


def hour_of(ts: Column) -> Column:
    """Start of the hour, as a naive timestamp."""
    return F.date_trunc("hour", ts).cast(T.TimestampNTZType())


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def low_confidence(sample_count: Column) -> Column:
    return (sample_count < LOW_CONFIDENCE_SAMPLES).cast("byte")


def time_of_day(hour: Column) -> Column:
    return (
        F.when(hour.between(6, 11), "morning")
        .when(hour.between(12, 16), "midday")
        .when(hour.between(17, 21), "evening")
        .otherwise("overnight")
    )


def congestion_bucket(value: Column, size: float = CONGESTION_BUCKET) -> Column:
    """Nearest multiple of ``size``, ties to even."""
    return F.bround(F.rint(value / F.lit(size)) * F.lit(size), 6) + F.lit(0.0)


def forecast_key(route_id: Column, horizon: Column, value: Column) -> Column:
    """Key under which equal forecasts are shared, e.g. ``forecast:132:3:10.0``.

    The bucket is printed through a decimal: a double of 1e7 or more would
    otherwise come out in scientific notation.
    """
    exact = congestion_bucket(value).cast("decimal(24,6)").cast("string")
    trimmed = F.regexp_replace(exact, r"0{1,5}$", "")
    return F.concat_ws(":", F.lit("forecast"), route_id.cast("string"), horizon.cast("string"), trimmed)


def zero_fill(df: DataFrame) -> DataFrame:
    """Nulls of every numeric column become 0."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=numeric) if numeric else df


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Keep rows without any null."""
    return df.dropna("any")


def split_requests(
    requests: DataFrame, routes: DataFrame, max_days: int = 7
) -> tuple[DataFrame, DataFrame]:
    """Requests ``(route_id, horizon)`` as accepted rows and rejects with a reason."""
    known = routes.select("route_id").distinct().withColumn("_known", F.lit(True))
    reason = (
        F.when(F.col("route_id").isNull() | (F.col("route_id") < 1), "route_id must be at least 1")
        .when(
            F.col("horizon").isNull() | ~F.col("horizon").between(1, max_days),
            f"horizon must be between 1 and {max_days} days",
        )
        .when(F.col("_known").isNull(), "route not found")
    )
    checked = requests.join(known, "route_id", "left").withColumn("reason", reason).drop("_known")
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )
