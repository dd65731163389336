"""Walk-forward validation, covariate ablation, conformal margins and the final models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from odflow.operators import conformal
from odflow.operators import validation as val
from odflow.operators.boosting import QuantileBoost
from odflow.operators.forest import QuantileForest
from odflow.session import materialise

METRICS = ["p10", "p50", "p90", "coverage_80pct"]


def _part(train: DataFrame, bounds: Row, role: str) -> DataFrame:
    """The rows of one fold and role, as a filter on literal keys."""

    def key(name: str) -> Column:
        if bounds[name] is None:
            return F.lit(None).cast("struct<hour:timestamp_ntz,route_id:bigint>")
        hour = F.lit(bounds[name]["hour"]).cast("timestamp_ntz")
        return F.struct(hour.alias("hour"), F.lit(bounds[name]["route_id"]).cast(kind).alias("route_id"))

    kind = train.schema["route_id"].dataType
    wanted = val.fold_role(key("train_before"), key("test_from"), key("test_before")) == role
    # The hour alone decides all but the boundary hours, and lets the reader skip row groups.
    last = bounds["train_before"] if role == "train" else bounds["test_before"]
    if last is not None:
        wanted = wanted & (F.col("hour") <= F.lit(last["hour"]).cast("timestamp_ntz"))
    return train.filter(wanted)


def fold_forecasts(
    train: DataFrame,
    features: list[str],
    folds: int = 5,
    gap: int = 24,
    bounds: list[Row] | None = None,
    model: type = QuantileForest,
    **settings,
) -> DataFrame:
    """Forecasts of the test rows of each fold by a model of its training rows, with ``fold`` and ``horizon``.

    ``model`` is called with the features and ``settings``, and has ``fit`` and ``predict``. ``train`` should be a
    stored (materialised) table: every fold is a filter on it, by a handful of boundary keys, and rows are
    neither copied nor moved. ``horizon`` is the number of days from the first test hour.
    """
    parts = []
    for fold in bounds or val.fold_bounds(train, folds, gap).collect():
        fitted = model(features=features, **settings).fit(_part(train, fold, "train"))
        first = F.lit(fold["test_from"]["hour"]).cast("timestamp_ntz")
        tested = fitted.predict(_part(train, fold, "test"))
        parts.append(
            tested.select(
                F.lit(fold["fold"]).alias("fold"), "route_id", "hour",
                conformal.days_ahead(F.col("hour"), first).alias("horizon"), "volume", *val.QUANTILES,
            )
        )
    return reduce(DataFrame.unionByName, parts)


def cross_validate(train: DataFrame, features: list[str], *args, **settings) -> DataFrame:
    """Pinball losses and coverage per fold of :func:`fold_forecasts`."""
    return val.quantile_metrics(fold_forecasts(train, features, *args, **settings), ["fold"])


def ablation(train: DataFrame, folds: int = 3, gap: int = 24, model: type = QuantileForest, **settings) -> DataFrame:
    """Fold means with and without the congestion features, one row per model and metric."""
    without = [f for f in val.TRAINING_FEATURES if f not in val.CONGESTION_FEATURES]
    runs = {"full": val.TRAINING_FEATURES, "no_congestion": without}
    bounds = val.fold_bounds(train, folds, gap).collect()
    parts = [
        cross_validate(train, names, folds, gap, bounds, model, **settings).withColumn("model", F.lit(run))
        for run, names in runs.items()
    ]
    return val.fold_means(reduce(DataFrame.unionByName, parts), METRICS)


def conformal_margins(train: DataFrame, features: list[str] | None = None, coverage: float = conformal.COVERAGE, **settings) -> DataFrame:
    """Margins per horizon from the held-out folds of ``train``; ``settings`` as in :func:`fold_forecasts`."""
    held_out = fold_forecasts(train, features or val.TRAINING_FEATURES, **settings)
    return materialise(conformal.margins(conformal.scores(held_out), coverage), "margins")


def evaluate(valid: DataFrame, fitted, margins: DataFrame, path: str) -> DataFrame:
    """Calibrated forecasts of the validation rows; the calibration record and the margins are written to ``path``."""
    first = valid.agg(F.min("hour")).scalar()
    raw = fitted.predict(valid).withColumn("horizon", conformal.days_ahead(F.col("hour"), first))
    done = materialise(conformal.calibrate(raw, margins), "calibrated")
    conformal.write_calibration(val.calibration(done), margins, path)
    return done


def train_forest(train: DataFrame, **forest) -> QuantileForest:
    return QuantileForest(features=val.TRAINING_FEATURES, **forest).fit(train)


def train_boost(train: DataFrame, valid: DataFrame | None = None, **boost) -> QuantileBoost:
    return QuantileBoost(features=val.TRAINING_FEATURES, **boost).fit(train, valid)
