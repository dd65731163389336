"""Point-in-time joins: the last value known at each row's own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a zone without a usable observation has.
NO_SIGNAL = {"travel_time_var": 0.0, "sample_count": 0}


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def last_known(
    requests: DataFrame,
    observations: DataFrame,
    keys: list[str],
    at: str,
    observed_at: str,
    values: list[str],
    max_age: str | None = None,
    bucket: str = "day",
) -> DataFrame:
    """``requests`` with, for each of ``values``, the last one not null at or before the time ``at``.

    ``max_age`` is an interval such as '6 hours': older values are null. Values of one key and time are one
    observation, the largest of each. Null keys and times match nothing; rows of ``requests`` are kept as they are,
    columns named as the values are replaced.

    Requests and observations go through one window by key and ``bucket`` of time, and what was known at the
    start of a bucket comes in as one more row, from a series with one row per key and bucket. So no
    row is joined to a range, and a busy key is spread over its buckets.
    """
    kept = [c for c in requests.columns if c not in values]
    time = requests.schema[at].dataType
    whole = F.struct(*[F.col(c) for c in kept])
    asked = requests.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(at).alias("_t"), F.lit(2).alias("_kind"), whole.alias("_row"),
        *[F.lit(None).alias(f"_{v}") for v in values],
    )
    seen = (
        observations.dropna("any", subset=[*keys, observed_at])
        .groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col(observed_at).cast(time).alias("_t"))
        .agg(*[F.max(v).alias(v) for v in values])
    )
    stamped = [F.when(F.col(v).isNotNull(), F.struct("_t", v)).alias(f"_{v}") for v in values]
    names, held = [f"_{k}" for k in keys], [f"_{v}" for v in values]
    # structs order by their time first, and times differ within a key
    known = seen.select(*names, "_t", *stamped).withColumn("_bucket", F.date_trunc(bucket, "_t").cast(time))
    asked = asked.withColumn("_bucket", F.date_trunc(bucket, "_t").cast(time))
    ends = known.groupBy(*names, "_bucket").agg(*[F.max(v).alias(v) for v in held])
    wanted = asked.select(*names, "_bucket").dropna("any").distinct()
    earlier = Window.partitionBy(*names).orderBy("_bucket", "_asked").rowsBetween(Window.unboundedPreceding, -1)
    series = ends.withColumn("_asked", F.lit(1)).unionByName(wanted.withColumn("_asked", F.lit(0)), allowMissingColumns=True)
    carried = (
        series.withColumns({v: F.last(v, ignorenulls=True).over(earlier) for v in held})
        .filter("_asked = 0")
        .select(*names, "_bucket", F.col("_bucket").alias("_t"), F.lit(0).alias("_kind"), *held)
    )
    rows = (
        known.withColumn("_kind", F.lit(1))
        .unionByName(carried)
        .unionByName(asked.select(*names, "_bucket", "_t", "_kind", "_row"), allowMissingColumns=True)
    )
    upto = Window.partitionBy(*names, "_bucket").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({v: F.last(v, ignorenulls=True).over(upto) for v in held}).filter("_kind = 2")
    fresh = F.lit(True) if max_age is None else None
    picked = []
    for v in values:
        taken = F.col(f"_{v}")
        young = fresh if fresh is not None else _micros(F.col("_t")) <= _micros(taken["_t"] + F.expr(f"INTERVAL {max_age}"))
        picked.append(F.when(young, taken[v]).alias(v))
    return found.select("_row.*", *picked)


def congestion_at(
    requests: DataFrame, congestion: DataFrame, zone: str = "zone_id", at: str = "as_of", max_age: str | None = None
) -> DataFrame:
    """Requests with the congestion of their zone as known at their own time; (0.0, 0) without one.

    An hour's value is known once the hour is over.
    """
    known = congestion.select(
        F.col("zone_id").alias(zone), (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("_known_at"), *NO_SIGNAL
    )
    return last_known(requests, known, [zone], at, "_known_at", list(NO_SIGNAL), max_age).fillna(NO_SIGNAL)
