"""Data-quality report of the feature table as rows (check, subject, value, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from odflow.session import small_side

# Fixed values.
WARM_UP_HOURS = 168
NULL_RATE_LIMIT = 0.05
LEAK_TOLERANCE = 1e-6
LEAK_MIN_ROWS = 100
KEY_FEATURES = [
    "volume",
    "origin_delay_index_lag1",
    "dest_delay_index_lag1",
    "origin_disruption_flag",
    "dest_disruption_flag",
]
SIGNAL_NAMES = ("delay_index", "disruption_flag", "low_confidence_flag")

Entry = tuple[str, str, Column, Column]


def since_start(features: DataFrame) -> DataFrame:
    """Add ``start_hour``, the first hour of each row's route; the wide rows stay where they are."""
    starts = features.groupBy("route_id").agg(F.min("hour").alias("start_hour"))
    return features.join(small_side(starts), "route_id", "left")


def _tidy(stats: DataFrame, entries: list[Entry]) -> DataFrame:
    rows = F.array(*[
        F.struct(
            F.lit(check).alias("check"),
            F.lit(subject).alias("subject"),
            value.cast("double").alias("value"),
            status.alias("status"),
        )
        for check, subject, value, status in entries
    ])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def _status(bad: Column, otherwise: str = "ok", label: str = "fail") -> Column:
    return F.when(bad, label).otherwise(otherwise)


def column_stats(columns: list[str]) -> list[Column]:
    """The aggregates behind the column checks, over rows with ``start_hour``."""
    warm = F.col("hour") >= F.col("start_hour") + F.make_dt_interval(F.lit(0), F.lit(WARM_UP_HOURS))
    signals = [c for c in columns if any(name in c for name in SIGNAL_NAMES)]
    keys = [c for c in KEY_FEATURES if c in columns]
    aggregates = [F.count(F.lit(1)).alias("n"), F.count_if(warm).alias("n_warm")]
    aggregates += [F.count(c).alias(f"have_{c}") for c in signals]
    aggregates += [f(c).alias(f"{name}_{c}") for c in keys for name, f in (("min", F.min), ("max", F.max))]
    aggregates += [F.count_if(warm & F.col(c).isNull()).alias(f"gap_{c}") for c in columns]
    if "origin_disruption_flag" in columns:
        aggregates.append(F.var_samp("origin_disruption_flag").alias("flag_variance"))
    return aggregates


def column_report(stats: DataFrame, columns: list[str]) -> DataFrame:
    """The column checks as rows, from the one row of :func:`column_stats`."""
    n, n_warm = F.col("n"), F.col("n_warm")
    entries: list[Entry] = [("rows", "features", n, F.lit("info"))]
    for c in [c for c in columns if any(name in c for name in SIGNAL_NAMES)]:
        bad = (n > 100) & (F.col(f"have_{c}") == 0)
        entries.append(("all_null", c, F.col(f"have_{c}"), _status(bad)))
    if "origin_disruption_flag" in columns:
        flat = (n > 200) & (F.coalesce("flag_variance", F.lit(0.0)) == 0)
        entries.append(
            ("variance", "origin_disruption_flag", F.col("flag_variance"), _status(flat, label="warn"))
        )
    for c in [c for c in KEY_FEATURES if c in columns]:
        entries.append(("min", c, F.col(f"min_{c}"), F.lit("info")))
        entries.append(("max", c, F.col(f"max_{c}"), F.lit("info")))
    for c in columns:
        rate = F.try_divide(F.col(f"gap_{c}"), n_warm)
        watched = "lag" in c or "rolling" in c
        status = _status(rate > NULL_RATE_LIMIT, label="warn") if watched else F.lit("info")
        entries.append(("null_rate", c, rate, status))
    return _tidy(stats, entries)


def column_checks(features: DataFrame) -> DataFrame:
    """Every check that is an aggregate of the feature table, in one pass."""
    return column_report(since_start(features).agg(*column_stats(features.columns)), features.columns)


def watch(features: DataFrame, demand: DataFrame, observation: Observation) -> DataFrame:
    """``features``, whose first action also fills ``observation`` with the aggregates of the column checks.

    The first hours of the routes come from the narrow ``demand`` table, of whose rows the feature table has all of each
    route that it has.
    """
    starts = demand.groupBy("route_id").agg(F.min("hour").alias("start_hour"))
    started = features.join(small_side(starts), "route_id", "left")
    return started.observe(observation, *column_stats(features.columns)).select(*features.columns)


def observed_checks(features: DataFrame, observation: Observation) -> DataFrame:
    """:func:`column_checks` from the metrics of a finished action; a plan that ended empty leaves none and is checked again."""
    found = observation.get
    if "n" not in found:
        return column_checks(features)
    one = features.sparkSession.range(1)
    return column_report(one.select(*[F.lit(v).alias(c) for c, v in found.items()]), features.columns)


def leakage(features: DataFrame, congestion: DataFrame) -> DataFrame:
    """Rows whose lag-1 value is not the congestion one hour before; too few rows to compare never fail."""
    before = congestion.select(
        F.col("zone_id").alias("origin_zone_id"),
        (F.col("hour") + F.expr("interval 1 hour")).alias("hour"),
        F.col("travel_time_var").alias("_expected"),
    )
    checked = features.filter(F.col("origin_delay_index_lag1").isNotNull()).select(
        "origin_zone_id", "hour", "origin_delay_index_lag1"
    )
    wrong = F.abs(F.col("origin_delay_index_lag1") - F.col("_expected")) > LEAK_TOLERANCE
    counted = checked.join(before, ["origin_zone_id", "hour"]).agg(
        F.count_if(wrong).alias("bad"), F.count(F.lit(1)).alias("compared")
    )
    failed = (F.col("bad") > 0) & (F.col("compared") > LEAK_MIN_ROWS)
    return _tidy(counted, [("leakage", "origin_delay_index_lag1", F.col("bad"), _status(failed))])


def largest_routes(features: DataFrame, n: int = 5) -> DataFrame:
    top = (
        features.groupBy("route_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "route_id")
        .limit(n)
    )
    return top.select(
        F.lit("route_rows").alias("check"),
        F.col("route_id").cast("string").alias("subject"),
        F.col("rows").cast("double").alias("value"),
        F.lit("info").alias("status"),
    )


def key_checks(df: DataFrame, keys: list[str], name: str, non_negative: list[str]) -> DataFrame:
    """Repeated keys, and negative values in columns that must not have any."""
    repeated = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("c"))
        .agg(F.count_if(F.col("c") > 1).alias("repeated"))
    )
    parts = [_tidy(repeated, [("primary_key", name, F.col("repeated"), _status(F.col("repeated") > 0))])]
    if non_negative:
        negatives = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in non_negative])
        parts.append(
            _tidy(negatives, [
                ("non_negative", f"{name}.{c}", F.col(c), _status(F.col(c) > 0)) for c in non_negative
            ])
        )
    return reduce(DataFrame.unionByName, parts)


def report(features: DataFrame, congestion: DataFrame, observation: Observation | None = None) -> DataFrame:
    """The whole report. Pass a written (or materialised) table: it is read three times.

    With the ``observation`` of the table's own write (see :func:`watch`) the wide pass over all columns is
    saved; what is left reads three narrow columns and one.
    """
    columns = observed_checks(features, observation) if observation else column_checks(features)
    return reduce(DataFrame.unionByName, [columns, leakage(features, congestion), largest_routes(features)])


def assert_clean(quality: DataFrame) -> None:
    """Raise when a check failed; the report is a few dozen rows."""
    failed = [f"{r['check']} {r['subject']}" for r in quality.filter("status = 'fail'").collect()]
    if failed:
        raise AssertionError("data quality: " + ", ".join(failed))
