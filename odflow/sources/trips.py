"""Monthly trip files: scan, normalise, keep each file's own month."""

from __future__ import annotations

import datetime as dt
import logging
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Trip columns kept, and the per-colour names of the two times.
TRIP_COLUMNS = [
    "pickup_datetime",
    "dropoff_datetime",
    "PULocationID",
    "DOLocationID",
    "trip_distance",
    "fare_amount",
]
TIME_ALIASES = {
    "yellow": {
        "tpep_pickup_datetime": "pickup_datetime",
        "tpep_dropoff_datetime": "dropoff_datetime",
    },
    "green": {
        "lpep_pickup_datetime": "pickup_datetime",
        "lpep_dropoff_datetime": "dropoff_datetime",
    },
}
log = logging.getLogger(__name__)
FILE_NAME = "{color}_tripdata_{year:04d}-{month:02d}.parquet"


def month_range(as_of: dt.date, months: int = 24) -> list[tuple[int, int]]:
    """The last ``months`` complete months before ``as_of``, newest first."""
    last = as_of.year * 12 + as_of.month - 2
    return [((last - back) // 12, (last - back) % 12 + 1) for back in range(months)]


def month_starts(as_of: DataFrame, months: int = 24) -> DataFrame:
    """:func:`month_range` for a one-row ``as_of`` table, as first days of the months."""
    newest = F.add_months(F.trunc("as_of", "month"), -1)
    days = F.sequence(newest, F.add_months(newest, 1 - months), F.expr("interval -1 month"))
    return as_of.select(F.explode(days).alias("month_start")).select(
        "month_start",
        F.year("month_start").alias("year"),
        F.month("month_start").alias("month"),
    )


def normalise(trips: DataFrame, color: str) -> DataFrame:
    """Rename the colour's time columns and keep those trip columns that exist."""
    renamed = trips.withColumnsRenamed(TIME_ALIASES.get(color, {}))
    kept = [c for c in TRIP_COLUMNS if c in renamed.columns]
    times = {c: F.col(c).cast(T.TimestampNTZType()) for c in kept if c.endswith("_datetime")}
    return renamed.withColumns(times) if times else renamed


def keep_file_month(trips: DataFrame, file_month: Column) -> DataFrame:
    """Drop rows whose pickup lies outside the month of their own file."""
    if "pickup_datetime" not in trips.columns:
        return trips
    return trips.filter(F.trunc(F.col("pickup_datetime").cast("date"), "month") == file_month)


def scan(
    spark: SparkSession,
    folder: str,
    colors: list[str],
    months: list[tuple[int, int]],
    skip_unreadable: bool = False,
    layout: str = FILE_NAME,
) -> DataFrame:
    """All trips of the given colours and months, with a ``color`` column.

    One read per colour takes all its files at once. ``layout`` is the path of a file
    below ``folder``, its month written like 2024-01 at the end of a name. The file's month
    comes from there, so a folder written by Spark counts as a file; the span of all months
    is also given as a plain range on the raw pickup column, which the Parquet reader
    uses to skip row groups. Columns are those of any file, null where a file lacks
    them; numbers are read in their widest type, as it differs between files. Months
    without a file are logged (see :func:`missing_files`). A file without a readable
    footer fails the scan, or is left out as a whole and logged with ``skip_unreadable``.
    """
    frames = []
    widest = {"PULocationID": "bigint", "DOLocationID": "bigint", "trip_distance": "double",
              "fare_amount": "double"}
    first, last = min(months), max(months)
    lower = dt.datetime(first[0], first[1], 1)
    upper = dt.datetime(last[0] + last[1] // 12, last[1] % 12 + 1, 1)
    for color in colors:
        wanted = [f"{folder}/{layout.format(color=color, year=y, month=m)}" for y, m in months]
        paths = _existing(spark, wanted)
        if not paths:
            continue
        for path in sorted(set(wanted) - set(paths)):
            log.warning("no trip file %s", path)
        known = [*TIME_ALIASES.get(color, {}), *TRIP_COLUMNS]
        fields = {path: _fields(spark, path, skip_unreadable) for path in paths}
        paths = [path for path in paths if fields[path] is not None]
        if not paths:
            continue
        found = {f.name: f for path in paths for f in fields[path] if f.name in known}
        schema = ", ".join(
            f"`{name}` {widest.get(name, f.dataType.simpleString())}" for name, f in found.items()
        )
        raw = (
            spark.read.schema(schema)
            .parquet(*paths)
            .withColumn("_month", F.to_date(
                F.concat(F.regexp_extract("_metadata.file_path", r".*[_=](\d{4}-\d{2})(?:\.parquet)?(?:/|$)", 1),
                         F.lit("-01"))
            ))
        )
        trips = normalise(raw, color)
        if "pickup_datetime" in trips.columns:
            pickup = F.col("pickup_datetime")
            trips = trips.filter(
                (pickup >= F.lit(lower).cast("timestamp_ntz"))
                & (pickup < F.lit(upper).cast("timestamp_ntz"))
            )
        trips = keep_file_month(trips, F.col("_month"))
        kept = [c for c in TRIP_COLUMNS if c in trips.columns]
        frames.append(trips.select(*kept, F.lit(color).alias("color")))
    if not frames:
        return spark.createDataFrame([], TRIP_SCHEMA)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


TRIP_SCHEMA = (
    "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID bigint,"
    " DOLocationID bigint, trip_distance double, fare_amount double, color string"
)


def missing_files(
    spark: SparkSession, folder: str, colors: list[str], months: list[tuple[int, int]]
) -> list[str]:
    """Paths of the wanted files that do not exist."""
    wanted = [f"{folder}/{FILE_NAME.format(color=c, year=y, month=m)}" for c in colors for y, m in months]
    return sorted(set(wanted) - set(_existing(spark, wanted)))


def _fields(spark: SparkSession, path: str, skip_unreadable: bool) -> list[T.StructField] | None:
    """Columns by the footer of one file; None for an unreadable file that is to be skipped."""
    try:
        return spark.read.parquet(path).schema.fields
    except (PySparkException, Py4JJavaError):
        if not skip_unreadable:
            raise
        log.warning("unreadable trip file %s", path)
        return None


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a short list of file names that exist on their file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        handle = jvm.org.apache.hadoop.fs.Path(path)
        if handle.getFileSystem(conf).exists(handle):
            found.append(path)
    return found
