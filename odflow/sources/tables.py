"""Stored tables: schemas, projections, text inputs and the feature snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEMAND = "route_id int, hour timestamp_ntz, volume int, avg_duration double"
ROUTES = "route_id int, origin_zone_id int, destination_zone_id int"
CONGESTION = (
    "zone_id int, hour timestamp_ntz, travel_time_var double, sample_count int,"
    " disruption_flag boolean"
)
DELAYS = "zone_id int, hour timestamp_ntz, feed_id string, mean_delay double, trip_count int"
STOP_MAP = "stop_id string, zone_id int"
STOPS = "stop_id string, stop_lat double, stop_lon double"

# Columns each reader needs of a stored table.
READS = {
    "demand": ["route_id", "hour", "volume", "avg_duration"],
    "routes": ["route_id", "origin_zone_id", "destination_zone_id"],
    "congestion": ["zone_id", "hour", "travel_time_var", "sample_count"],
}


def read_table(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """The projection of a stored table that the feature job works on."""
    return spark.read.parquet(f"{warehouse}/{name}").select(*READS[name])


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Headed CSV with the columns of ``schema``; rows lacking a required value are dropped."""
    columns = [field.split()[0] for field in schema.split(",")]
    raw = spark.read.option("header", True).csv(path)
    typed = [F.col(f.split()[0]).cast(f.split()[1]) for f in map(str.strip, schema.split(","))]
    return raw.select(*typed).toDF(*[c.strip() for c in columns]).dropna(subset=required)


def parse_csv(lines: DataFrame, line: str, schema: str, required: list[str]) -> DataFrame:
    """CSV lines held in a text column, under the same rules as :func:`read_csv`."""
    parsed = lines.select(F.from_csv(line, schema).alias("_row")).select("_row.*")
    return parsed.dropna(subset=required)


def event_date(value: Column) -> Column:
    """ISO date before the ``T`` of an event start, null when it is not one."""
    day = F.split_part(value, F.lit("T"), F.lit(1))
    return F.coalesce(F.try_to_date(day, "yyyy-MM-dd"), F.try_to_date(day, "yyyyMMdd"))


def event_dates(payloads: DataFrame, payload: str) -> DataFrame:
    """Distinct event dates of JSON documents; a document that is no list gives none."""
    listed = F.when(
        F.ltrim(F.col(payload)).startswith("["),
        F.from_json(payload, "array<struct<event_start_date:string>>"),
    )
    return (
        payloads.select(F.explode(listed).alias("item"))
        .select(event_date(F.col("item.event_start_date")).alias("event_date"))
        .filter(F.col("event_date").isNotNull())
        .distinct()
    )


def read_event_dates(spark: SparkSession, path: str) -> DataFrame:
    """Distinct event dates of files that each hold one JSON list."""
    return event_dates(spark.read.text(path, wholetext=True), "value")


def write_features(features: DataFrame, path: str, cutoff: Column) -> None:
    """Add or replace the snapshot of one training cutoff; others stay as they are."""
    (
        features.withColumn("cutoff_date", cutoff.cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cutoff_date")
        .parquet(path)
    )


def read_features(spark: SparkSession, path: str, cutoff: str) -> DataFrame:
    """The snapshot of one training cutoff."""
    table = spark.read.parquet(path)
    return table.filter(F.col("cutoff_date") == F.lit(cutoff).cast("date")).drop("cutoff_date")
