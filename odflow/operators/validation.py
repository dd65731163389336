"""Time splits, walk-forward folds and forecast metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.functions.windows import ordered_index
from odflow.session import small_side

# The 31 training features in their order.
TRAINING_FEATURES = [
    "route_id",
    "origin_travel_time_var",
    "dest_travel_time_var",
    "hour_of_day",
    "dow",
    "month",
    "week_of_year",
    "is_weekend",
    "days_to_next_us_holiday",
    "nyc_event_flag",
    "lag_1h",
    "lag_2h",
    "lag_3h",
    "lag_24h",
    "lag_168h",
    "rolling_mean_3h",
    "rolling_mean_24h",
    "rolling_mean_168h",
    "ewm_trend_24h",
    "yoy_ratio",
    "origin_delay_index_lag1",
    "origin_delay_index_rolling3h",
    "origin_disruption_flag",
    "dest_delay_index_lag1",
    "dest_delay_index_rolling3h",
    "dest_disruption_flag",
    "duration_lag_1h",
    "duration_lag_24h",
    "duration_lag_168h",
    "duration_rolling_mean_3h",
    "duration_rolling_mean_24h",
]
# Left out in the ablation run.
CONGESTION_FEATURES = [
    "origin_travel_time_var",
    "dest_travel_time_var",
    "origin_delay_index_lag1",
    "origin_delay_index_rolling3h",
    "origin_disruption_flag",
    "dest_delay_index_lag1",
    "dest_delay_index_rolling3h",
    "dest_disruption_flag",
]
QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
TRAIN_SHARE = 0.8


def hour_index(df: DataFrame, out: str = "time_idx") -> DataFrame:
    """Distinct hours with their 0-based position; as long as the calendar, not the table."""
    hours = df.select("hour").distinct().withColumn("_day", F.col("hour").cast("date"))
    return ordered_index(hours, "_day", ["hour"], out).select("hour", F.col(out).cast("int").alias(out))


def dense_time_index(train: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``time_idx`` counts the training hours from 0; validation goes on behind them."""
    offset = train.agg(F.count_distinct("hour")).scalar()
    later = hour_index(valid).withColumn("time_idx", (F.col("time_idx") + offset).cast("int"))
    return train.join(small_side(hour_index(train)), "hour"), valid.join(small_side(later), "hour")


def cutoff_hour(df: DataFrame) -> dt.datetime | None:
    """The boundary hour: 80 % of the distinct hours lie before it.

    Fetched once, so that the split is a filter on a constant in every later job.
    """
    index = hour_index(df)
    n = index.agg(F.count(F.lit(1))).scalar()
    place = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(TRAIN_SHARE))), n - 1)
    row = index.filter(F.col("time_idx") == place).agg(F.max("hour"), F.max(n)).first()
    return row[0] if row[1] and row[1] > 1 else None


def time_split(
    df: DataFrame, features: list[str] | None = None, check: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows without nulls, before and after the boundary hour; that hour is dropped.

    ``check`` also refuses a split with an empty side.
    """
    missing = sorted(set(features or TRAINING_FEATURES) - set(df.columns))
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    complete = df.dropna("any")
    boundary = cutoff_hour(complete)
    if boundary is None:
        raise ValueError("need at least two distinct hours to split")
    cutoff = F.lit(boundary).cast("timestamp_ntz")
    train, valid = complete.filter(F.col("hour") < cutoff), complete.filter(F.col("hour") > cutoff)
    if check and (train.isEmpty() or valid.isEmpty()):
        raise ValueError("the split leaves the training or validation side empty")
    return train, valid


def row_index(df: DataFrame, out: str = "row_idx") -> DataFrame:
    """Position of each row in the order (hour, route)."""
    return ordered_index(df, "hour", ["route_id"], out)


def fold_bounds(df: DataFrame, folds: int = 5, gap: int = 24) -> DataFrame:
    """Where each fold begins and ends in the order (hour, route): one row per fold.

    Columns ``train_before``, ``test_from`` and ``test_before`` are keys
    ``(hour, route_id)``; the last is null for the newest fold, the first when
    the gap leaves nothing to train on. Only the two key columns are numbered,
    so the feature rows never move.
    """
    index = row_index(df.select("hour", "route_id")).withColumn(
        "_n", df.agg(F.count(F.lit(1))).scalar()
    )
    n = F.col("_n")
    size = F.floor(n / F.lit(folds + 1))

    def key_at(place: Column) -> Column:
        return F.max(F.when(F.col("row_idx") == place, F.struct("hour", "route_id")))

    bounds = []
    for fold in range(folds):
        start = n - F.lit(folds - fold) * size
        bounds.append(
            F.struct(
                F.lit(fold).alias("fold"),
                key_at(start - gap).alias("train_before"),
                key_at(start).alias("test_from"),
                key_at(start + size).alias("test_before"),
            )
        )
    return index.agg(F.array(*bounds).alias("b")).select(F.explode("b").alias("b")).select("b.*")


def fold_role(train_before: Column, test_from: Column, test_before: Column) -> Column:
    """'train', 'test' or null for a row with ``hour`` and ``route_id``."""
    key = F.struct("hour", "route_id")
    return F.when(key < train_before, "train").when(
        (key >= test_from) & (test_before.isNull() | (key < test_before)), "test"
    )


def walk_forward(df: DataFrame, folds: int = 5, gap: int = 24) -> DataFrame:
    """Rows with ``fold`` and ``role`` ('train' or 'test') of an expanding-window split.

    Every fold tests ``n // (folds + 1)`` rows, the last fold the newest ones, and
    trains on all rows that end ``gap`` rows before its test rows begin.
    """
    ordered = F.array_sort(F.collect_list(F.struct("fold", "train_before", "test_from", "test_before")))
    bounds = fold_bounds(df, folds, gap).agg(ordered).scalar()
    role = fold_role(F.col("_b.train_before"), F.col("_b.test_from"), F.col("_b.test_before"))
    return (
        df.withColumn("_b", F.explode(bounds))
        .withColumns({"fold": F.col("_b.fold"), "role": role})
        .drop("_b")
        .filter(F.col("role").isNotNull())
    )


def walk_forward_hours(df: DataFrame, folds: int = 5, gap: int = 24) -> DataFrame:
    """The same split counted in hours, so that no hour is cut in two."""
    index = hour_index(df, "hour_idx")
    n = index.agg(F.count(F.lit(1))).scalar()
    size = F.floor(n / F.lit(folds + 1))
    start = n - (F.lit(folds) - F.col("fold")) * size
    role = F.when(F.col("hour_idx") < start - gap, "train").when(
        (F.col("hour_idx") >= start) & (F.col("hour_idx") < start + size), "test"
    )
    roles = (
        index.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .select("hour", "fold", "role")
    )
    return df.join(small_side(roles), "hour")


def pinball(actual: Column, forecast: Column, level: float) -> Column:
    error = actual - forecast
    return F.when(error >= 0, F.lit(level) * error).otherwise(F.lit(level - 1.0) * error)


def interval_coverage(actual: Column, low: Column, high: Column) -> Column:
    return ((actual >= low) & (actual <= high)).cast("double")


def quantile_metrics(predictions: DataFrame, by: list[str], actual: str = "volume") -> DataFrame:
    """Mean pinball loss per quantile and coverage of the 80 % interval, as columns."""
    y = F.col(actual)
    losses = [F.avg(pinball(y, F.col(name), q)).alias(name) for name, q in QUANTILES.items()]
    covered = F.avg(interval_coverage(y, F.col("p10"), F.col("p90"))).alias("coverage_80pct")
    return predictions.groupBy(*by).agg(*losses, covered)


def point_metrics(predictions: DataFrame, by: list[str], actual: str = "volume") -> DataFrame:
    """Mean absolute and root mean squared error of the median."""
    error = F.col("p50") - F.col(actual)
    return predictions.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")
    )


def fold_means(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean of each metric column over the folds, one row per model and metric."""
    tall = metrics.unpivot(["model"], names, "metric", "value")
    return tall.groupBy("model", "metric").agg(F.avg("value").alias("mean_value"))


def calibration(predictions: DataFrame, actual: str = "volume") -> DataFrame:
    """Share of observations at or below each quantile forecast."""
    observed = predictions.agg(
        *[F.avg((F.col(actual) <= F.col(name)).cast("double")).alias(name) for name in QUANTILES]
    )
    rows = F.array(*[
        F.struct(F.lit(q).alias("nominal"), F.col(name).alias("observed"))
        for name, q in QUANTILES.items()
    ])
    return observed.select(F.explode(rows).alias("r")).select("r.*")


def max_difference(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Largest absolute difference per column between two prediction sets."""
    other = right.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    gaps = left.join(other, keys).agg(
        *[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(c) for c in columns]
    )
    return gaps.unpivot([], columns, "column", "max_abs_diff")


def within(differences: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    return differences.withColumn("ok", F.col("max_abs_diff") <= tolerance)
