from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflow.operators import conformal
from odflow.operators import validation as val
from odflow.operators.boosting import QuantileBoost
from odflow.plans import training

START = dt.datetime(2024, 1, 1)


def scored(spark, rows):
    return spark.createDataFrame(rows, "horizon int, score double")


def brute_margin(values, coverage):
    k = math.ceil(round((len(values) + 1) * coverage, 9))
    return sorted(values)[k - 1] if k <= len(values) else None


@pytest.mark.parametrize("coverage", [0.8, 0.5, 0.99])
def test_margins_match_sorting(spark, coverage):
    rng = np.random.default_rng(6)
    groups = {1: rng.normal(size=40_000), 2: np.round(rng.exponential(3, 25_000)), 3: rng.normal(size=7), 4: [2.5], 5: [1.0] * 30_000}
    rows = [(h, float(v)) for h, values in groups.items() for v in values]
    got = conformal.margins(scored(spark, [*rows, (None, 1.0), (6, None)]).repartition(6), coverage).collect()
    assert {r["horizon"]: (r["n"], r["margin"]) for r in got} == {
        h: (len(v), brute_margin(list(map(float, v)), coverage)) for h, v in groups.items()
    }


def test_no_rows_and_too_few(spark):
    assert conformal.margins(scored(spark, [])).count() == 0
    found = conformal.margins(scored(spark, [(0, 1.0), (0, 3.0), (2, 1.0)]))
    assert {r["horizon"]: r["margin"] for r in found.collect()} == {0: None, 2: None}
    forecasts = spark.createDataFrame([(2, 4.0, 5.0, 6.0)], "horizon int, p10 double, p50 double, p90 double")
    assert tuple(conformal.calibrate(forecasts, found).first()) == (2, 4.0, 5.0, 6.0)


def test_calibrated_levels_stay_in_order(spark):
    margins = spark.createDataFrame([(0, 9, 1.0), (1, 9, 10.0), (2, 9, -50.0), (3, 1, None)], "horizon int, n long, margin double")
    rows = [(h, 4.0, 5.0, 6.0) for h in (1, 2, 3, 7, None)]
    forecasts = spark.createDataFrame(rows, "horizon int, p10 double, p50 double, p90 double")
    got = {r["horizon"]: (r["p10"], r["p50"], r["p90"]) for r in conformal.calibrate(forecasts, margins).collect()}
    assert got == {1: (0.0, 5.0, 16.0), 2: (5.0, 5.0, 5.0), 3: (3.0, 5.0, 7.0), 7: (3.0, 5.0, 7.0), None: (3.0, 5.0, 7.0)}
    assert conformal.calibrate(forecasts, margins, floor=None).filter("horizon = 1").first()["p10"] == -6.0


def test_days_ahead(spark):
    rows = [(START + dt.timedelta(hours=h), START) for h in (0, 23, 24, 24 * 6, 24 * 30)]
    df = spark.createDataFrame(rows, "hour timestamp_ntz, first timestamp_ntz")
    assert [r[0] for r in df.select(conformal.days_ahead(F.col("hour"), F.col("first"))).collect()] == [1, 1, 2, 7, 7]


class Narrow:
    """A model whose interval is far too small: the mean of the hour of day, a little to each side."""

    def __init__(self, features):
        assert features == ["hour_of_day"]

    def fit(self, train):
        self.means = train.groupBy("hour_of_day").agg(F.avg("volume").alias("p50"))
        return self

    def predict(self, df):
        return df.join(self.means, "hour_of_day").withColumns({"p10": F.col("p50") - 0.5, "p90": F.col("p50") + 0.5})


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [
        (r, START + dt.timedelta(hours=h), float(rng.poisson(20 + 8 * math.sin(h % 24 / 4) + r)), h % 24)
        for r in range(6) for h in range(24 * 60)
    ]
    df = spark.createDataFrame(rows, "route_id long, hour timestamp_ntz, volume double, hour_of_day int")
    return val.time_split(df, ["hour_of_day"])


def test_coverage_is_near_nominal_and_the_record_is_written(spark, series, tmp_path):
    train, valid = series
    margins = training.conformal_margins(train, ["hour_of_day"], folds=5, model=Narrow)
    assert {r["horizon"] for r in margins.collect()} >= {0, 1, 2, 7}
    fitted = Narrow(["hour_of_day"]).fit(train)
    raw = val.quantile_metrics(fitted.predict(valid), []).first()["coverage_80pct"]
    done = training.evaluate(valid, fitted, margins, str(tmp_path))
    assert raw < 0.2 and abs(val.quantile_metrics(done, []).first()["coverage_80pct"] - 0.8) < 0.02
    (record,) = (tmp_path / "calibration").glob("*.json")
    stored = json.loads(record.read_text())
    assert stored["nominal"] == [0.1, 0.5, 0.9] and len(stored["observed"]) == 3
    assert abs(stored["observed"][0] - 0.1) < 0.05 and abs(stored["observed"][2] - 0.9) < 0.05
    assert spark.read.parquet(f"{tmp_path}/margins").count() == margins.count()


def test_boosted_model_in_the_folds(series):
    train, _ = series
    small = train.filter("route_id < 2")
    folds = training.fold_forecasts(small, ["hour_of_day"], folds=2, model=QuantileBoost, rounds=2, depth=2)
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {0, 1}
    assert folds.filter("p10 > p50 OR p50 > p90").count() == 0
    assert training.cross_validate(small, ["hour_of_day"], folds=2, model=QuantileBoost, rounds=2, depth=2).count() == 2
