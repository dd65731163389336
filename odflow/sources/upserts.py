"""Merges into stored tables.

Plain Parquet has no MERGE. Each merge is a DataFrame of the new table content;
:func:`upsert` writes it back for the touched days only. The incoming side is
one batch, so the planner can send it to the stored side; no side is forced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflow.session import materialise


def last_per_key(incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key, without the columns ``order``: the last by these, such as a file's date and a row's place in it.

    Nulls there come first. Rows that are equal in ``order``, or all where none is given, are settled by the largest in
    the other columns, so that repeats agree.
    """
    order = order or []
    kept = [c for c in incoming.columns if c not in order]
    others = [c for c in kept if c not in keys]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order, *others)).alias("_last"))
    return last.select(*[c if c in keys else F.col(f"_last.{c}").alias(c) for c in kept])


def last_wins(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Stored rows, replaced by the incoming row of :func:`last_per_key` wherever the key is the same."""
    one = last_per_key(incoming, keys, order)
    kept = stored.join(one.select(*keys), keys, "left_anti")
    return kept.unionByName(one)


def demand_rows(hourly: DataFrame, routes: DataFrame) -> DataFrame:
    """Hourly pair counts as demand rows; pairs without a route are dropped."""
    named = routes.select(
        "route_id",
        F.col("origin_zone_id").alias("PULocationID"),
        F.col("destination_zone_id").alias("DOLocationID"),
    )
    return hourly.join(named, ["PULocationID", "DOLocationID"]).select(
        "route_id",
        "hour",
        F.col("pickup_count").alias("volume"),
        F.coalesce("avg_duration", F.lit(0.0)).alias("avg_duration"),
    )


def merge_demand(stored: DataFrame, hourly: DataFrame, routes: DataFrame) -> DataFrame:
    return last_wins(stored, demand_rows(hourly, routes), ["route_id", "hour"])


def merge_congestion(stored: DataFrame, variances: DataFrame) -> DataFrame:
    """New variances overwrite the stored ones and clear their disruption flag."""
    incoming = variances.withColumn("disruption_flag", F.lit(False))
    return last_wins(stored, incoming, ["zone_id", "hour"])


def merge_delays(parts: DataFrame) -> DataFrame:
    """Count-weighted mean of delay rows that share ``(zone_id, hour, feed_id)``.

    Merging is a sum, so any number of batches merge at once in any order.
    """
    return parts.groupBy("zone_id", "hour", "feed_id").agg(
        (F.sum(F.col("mean_delay") * F.col("trip_count")) / F.sum("trip_count")).alias("mean_delay"),
        F.sum("trip_count").alias("trip_count"),
    )


def new_routes(stored: DataFrame, selected: DataFrame) -> DataFrame:
    """Pairs not stored yet, numbered after the highest id by falling volume.

    ``selected`` holds one row per pair above the volume threshold, at most the
    square of the number of zones; only that list is numbered as a whole.
    """
    fresh = selected.select(
        F.col("PULocationID").alias("origin_zone_id"),
        F.col("DOLocationID").alias("destination_zone_id"),
        "avg_monthly_volume",
    ).join(
        stored.select("origin_zone_id", "destination_zone_id"),
        ["origin_zone_id", "destination_zone_id"],
        "left_anti",
    )
    by_volume = Window.orderBy(
        F.desc("avg_monthly_volume"), "origin_zone_id", "destination_zone_id"
    )
    top = stored.agg(F.coalesce(F.max("route_id"), F.lit(0)).alias("top")).scalar()
    return fresh.select(
        (top + F.row_number().over(by_volume)).cast("int").alias("route_id"),
        "origin_zone_id",
        "destination_zone_id",
    )


def flag_updates(stored: DataFrame, features: DataFrame) -> DataFrame:
    """Rows whose recomputed disruption flag is known and differs from the stored one."""
    fresh = features.select(
        "zone_id", "hour", F.col("disruption_flag").cast("boolean").alias("new_flag")
    )
    return (
        stored.select("zone_id", "hour", "disruption_flag")
        .join(fresh, ["zone_id", "hour"])
        .filter(F.col("new_flag") != F.col("disruption_flag"))
        .select("zone_id", "hour", F.col("new_flag").alias("disruption_flag"))
    )


def apply_flags(stored: DataFrame, updates: DataFrame) -> DataFrame:
    changed = updates.select("zone_id", "hour", F.col("disruption_flag").alias("_new"))
    return stored.join(changed, ["zone_id", "hour"], "left").withColumn(
        "disruption_flag", F.coalesce("_new", "disruption_flag")
    ).select(*stored.columns)


def missing_days(span: DataFrame, present: DataFrame, ts: str) -> DataFrame:
    """Days from ``start`` to ``end`` (both inclusive) without a row in ``present``."""
    days = span.select(F.explode(F.sequence("start", "end")).alias("day"))
    have = present.select(F.col(ts).cast("date").alias("day")).distinct()
    return days.join(have, "day", "left_anti")


def upsert(
    spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], day: Column, order: list[str] | None = None
) -> None:
    """Last-wins merge of ``incoming`` into the day-partitioned table at ``path``.

    Only the days that occur in ``incoming`` are read and rewritten. Running the
    same batch again gives the same table. A day holds at most 24 rows per key,
    so one file per day is written. Repeated keys inside the batch are settled
    by ``order`` (see :func:`last_per_key`), also in the first batch.
    """
    batch = materialise(last_per_key(incoming.withColumn("day", day.cast("date")), keys, order), "batch")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    merged = batch
    if exists:
        # A batch has at most one day per calendar day; the list prunes the partitions.
        days = [row["day"] for row in batch.select("day").distinct().collect()]
        stored = spark.read.parquet(path).filter(F.col("day").isin(days))
        kept = stored.select(*batch.columns).join(batch.select(*keys), keys, "left_anti")
        merged = kept.unionByName(batch)
    (
        merged.repartition("day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
