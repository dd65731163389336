"""The domain tables, derived from the star-schema and event tables.

``events`` supplies hourly trips, demand, vehicle samples and stop delays;
orders and line items supply trips at day grain; suppliers and customers supply
stops; nations supply zones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.functions.scalars import hour_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_trips(spark: SparkSession, folder: str) -> DataFrame:
    """One trip per event: it lasts ``value - 20`` minutes, so some end before they start."""
    user = F.col("user_id")
    return table(spark, folder, "events").select(
        F.col("ts").alias("pickup_datetime"),
        (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, (value - 20) * 60)")).alias("dropoff_datetime"),
        F.pmod(user, F.lit(5)).alias("PULocationID"),
        (F.pmod((user / 5).cast("long"), F.lit(2)) + 5).alias("DOLocationID"),
        F.when(F.col("event_type").isin("click", "view"), "yellow").otherwise("green").alias("color"),
    )


def order_trips(spark: SparkSession, folder: str) -> DataFrame:
    """One trip per line item, from the customer's to the supplier's nation."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_shipdate", "l_linestatus", "l_quantity", "l_extendedprice"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    # The line items join last, so that they move as seldom as possible.
    origins = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(origins, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("o_orderdate").alias("pickup_datetime"),
            F.col("l_shipdate").alias("dropoff_datetime"),
            F.col("c_nationkey").cast("long").alias("PULocationID"),
            F.col("s_nationkey").cast("long").alias("DOLocationID"),
            F.col("l_quantity").alias("trip_distance"),
            F.col("l_extendedprice").alias("fare_amount"),
            F.when(F.col("l_linestatus") == "F", "yellow").otherwise("green").alias("color"),
        )
    )


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """Ten routes over seven zones, numbered from 1."""
    user = F.col("user_id")
    return (
        table(spark, folder, "events")
        .select(
            (F.pmod(user, F.lit(10)) + 1).alias("route_id"),
            F.pmod(user, F.lit(5)).alias("origin_zone_id"),
            (F.pmod((user / 5).cast("long"), F.lit(2)) + 5).alias("destination_zone_id"),
        )
        .distinct()
    )


def demand(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly volume and mean value per route."""
    return (
        table(spark, folder, "events")
        .groupBy((F.pmod("user_id", F.lit(10)) + 1).alias("route_id"), hour_of(F.col("ts")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("volume"), F.avg("value").alias("avg_duration"))
    )


def zone_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Travel-time samples already assigned to one of seven zones."""
    return table(spark, folder, "events").select(
        F.pmod("user_id", F.lit(7)).alias("zone_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("segment_travel_time"),
    )


def stop_map(spark: SparkSession, folder: str) -> DataFrame:
    """Stops are supplier keys; users beyond them are stops without a zone."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("stop_id"), F.col("s_nationkey").alias("zone_id")
    )


def stop_delays(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("stop_id"),
        F.col("value").alias("delay"),
        F.col("event_type").alias("feed_id"),
        F.col("ts").alias("polled_at"),
    )


def zone_edges(spark: SparkSession, folder: str) -> DataFrame:
    """An L-shaped polygon per nation on a 5 x 5 grid, as edges.

    The upper right quarter of every unit square belongs to no zone, and
    neighbouring zones share edges.
    """
    corners = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0)]
    x0 = F.pmod("n_nationkey", F.lit(5))
    y0 = (F.col("n_nationkey") / 5).cast("int")
    edges = [
        F.struct(
            (x0 + F.lit(a[0])).alias("x1"),
            (y0 + F.lit(a[1])).alias("y1"),
            (x0 + F.lit(b[0])).alias("x2"),
            (y0 + F.lit(b[1])).alias("y2"),
        )
        for a, b in zip(corners, corners[1:] + corners[:1])
    ]
    return (
        table(spark, folder, "nation")
        .select(F.col("n_nationkey").alias("zone_id"), F.explode(F.array(*edges)).alias("e"))
        .select("zone_id", "e.*")
    )


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """Vehicle positions on a 0.01 grid, so that many lie on zone boundaries."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        (F.pmod(F.col("event_id") * 7919, F.lit(500)) / 100.0).alias("longitude"),
        (F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(500)) / 100.0).alias("latitude"),
        F.col("value").alias("segment_travel_time"),
    )


def stops(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as stops, placed by key and balance."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("stop_id"),
        (F.pmod(F.col("c_custkey") * 7919, F.lit(500)) / 100.0).alias("stop_lon"),
        (F.pmod(F.round(F.col("c_acctbal") * 100).cast("long"), F.lit(500)) / 100.0).alias("stop_lat"),
    )
