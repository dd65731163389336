from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from odflow.functions import calendar
from odflow.operators.congestion import congestion_features
from odflow.operators.demand import DEMAND_LAGS, DEMAND_WINDOWS, demand_features, duration_features

START = dt.datetime(2024, 1, 1)
NTZ = "route_id int, hour timestamp_ntz, volume {}"


def demand(spark, values, kind="double", gaps=1):
    number = {"double": float, "int": int}[kind]
    rows = [
        (route, START + dt.timedelta(hours=i * gaps), None if v is None else number(v))
        for route, vs in values.items()
        for i, v in enumerate(vs)
    ]
    return spark.createDataFrame(rows, NTZ.format(kind)).orderBy(F.rand(3))


def collected(df, key="route_id"):
    return df.toPandas().sort_values([key, "hour"]).reset_index(drop=True)


def same(got, want):
    np.testing.assert_allclose(
        got.astype(float).to_numpy(), want.astype(float).to_numpy(), rtol=1e-9, atol=1e-9, equal_nan=True
    )


@pytest.mark.parametrize("kind", ["double", "int"])
def test_windows_match_pandas_on_long_series(spark, kind):
    """Long enough for several trend blocks; rows arrive shuffled; hours have gaps."""
    rng = np.random.default_rng(1)
    values = {r: [int(v) for v in rng.integers(0, 90, 1300)] for r in (1, 2)}
    if kind == "double":
        values = {r: [float(v) for v in vs] for r, vs in values.items()}
    got = collected(demand_features(demand(spark, values, kind, gaps=3), year_rows=400))
    for route, vs in values.items():
        part = got[got.route_id == route].reset_index(drop=True)
        series = pd.Series(vs, dtype=float)
        for n in DEMAND_LAGS:
            same(part[f"lag_{n}h"], series.shift(n))
        for n in DEMAND_WINDOWS:
            same(part[f"rolling_mean_{n}h"], series.shift(1).rolling(n).mean())
        same(part["ewm_trend_24h"], series.shift(1).ewm(span=24, adjust=False).mean())
        ratio = (series / series.shift(400).clip(lower=1e-3)).clip(0.01, 100.0)
        same(part["yoy_ratio"], ratio)


def test_no_leak_between_routes_and_rows_kept(spark):
    got = collected(demand_features(demand(spark, {1: [1.0, 2, 3, 4, 5], 2: [6.0, 7, 8, 9, 10]})))
    assert len(got) == 10
    firsts = got.groupby("route_id").head(1)
    assert firsts["lag_1h"].isna().all() and firsts["ewm_trend_24h"].isna().all()
    assert not [c for c in got.columns if c.startswith("_")]


def test_year_ratio_is_bounded(spark):
    values = {1: [float(i % 100 + 1) for i in range(8762)]}
    ratios = collected(demand_features(demand(spark, values)))["yoy_ratio"].dropna()
    assert len(ratios) == 2 and ratios.between(0.01, 100.0).all()


def test_null_volume_empties_its_windows(spark):
    got = collected(demand_features(demand(spark, {1: [1, 2, None, 4, 5, 6, 7]}, "int")))
    assert got["rolling_mean_3h"].isna().tolist() == [True] * 6 + [False]


def test_duration_features(spark):
    df = demand(spark, {1: [1.0] * 30})
    assert duration_features(df).columns == df.columns
    timed = df.withColumn("avg_duration", F.hour("hour").cast("double"))
    got = collected(duration_features(timed))
    same(got["duration_lag_24h"], got["avg_duration"].shift(24))
    same(got["duration_rolling_mean_3h"], got["avg_duration"].shift(1).rolling(3).mean())


def zones(spark, values, samples=15):
    rows = [
        (z, START + dt.timedelta(hours=i), float(v), samples if i % 10 else 5)
        for z, vs in values.items()
        for i, v in enumerate(vs)
    ]
    return spark.createDataFrame(
        rows, "zone_id int, hour timestamp_ntz, travel_time_var double, sample_count int"
    )


def test_congestion_features_match_pandas(spark):
    rng = np.random.default_rng(2)
    values = {z: rng.gamma(1.0, 50.0, 400) for z in (1, 2)}
    got = collected(congestion_features(zones(spark, values)), "zone_id")
    for z, vs in values.items():
        part, series = got[got.zone_id == z].reset_index(drop=True), pd.Series(vs)
        same(part["delay_index_lag1"], series.shift(1))
        same(part["delay_index_rolling3h"], series.shift(1).rolling(3).mean())
        mean, std = series.shift(1).rolling(168).mean(), series.shift(1).rolling(168).std()
        flag = (series > mean + 2 * std).astype(float).where(mean.notna())
        same(part["disruption_flag"], flag)
        assert part["low_confidence_flag"].tolist() == [int(i % 10 == 0) for i in range(400)]


def test_legacy_congestion_columns(spark):
    old = zones(spark, {1: [1.0, 2.0]}).withColumnRenamed("travel_time_var", "delay_index").drop("sample_count")
    got = collected(congestion_features(old), "zone_id")
    assert got["sample_count"].tolist() == [0, 0] and got["delay_index_lag1"][1] == 1.0
    with pytest.raises(ValueError):
        congestion_features(old.drop("delay_index"))


def hours(spark, *stamps):
    return spark.createDataFrame([(s,) for s in stamps], "hour timestamp_ntz")


def test_event_flag(spark):
    df = hours(spark, dt.datetime(2024, 3, 17, 10), dt.datetime(2024, 6, 5, 9), dt.datetime(2024, 5, 20, 12))
    events = spark.createDataFrame([(dt.date(2024, 5, 20),)] * 2, "event_date date")
    got = calendar.calendar_features(df, events).toPandas().set_index("hour")["nyc_event_flag"]
    assert got.to_dict() == {
        pd.Timestamp("2024-03-17 10:00"): 1, pd.Timestamp("2024-06-05 09:00"): 0, pd.Timestamp("2024-05-20 12:00"): 1
    }


def test_weekday_conventions(spark):
    df = hours(spark, *[dt.datetime(2024, 1, d) for d in range(1, 8)])
    batch = calendar.calendar_features(df).toPandas().sort_values("hour")
    serving = calendar.serving_calendar(df, "hour").toPandas().sort_values("hour")
    assert batch["dow"].tolist() == [1, 2, 3, 4, 5, 6, 7]
    assert serving["dow"].tolist() == [0, 1, 2, 3, 4, 5, 6]
    assert batch["is_weekend"].tolist() == serving["is_weekend"].tolist() == [0] * 5 + [1] * 2


def test_month_cycle(spark):
    df = hours(spark, dt.datetime(2025, 1, 15), dt.datetime(2025, 12, 15))
    got = calendar.serving_calendar(df, "hour").toPandas().sort_values("hour")
    (s0, s1), (c0, c1) = got["month_sin"], got["month_cos"]
    assert s0 == pytest.approx(0.0) and c0 == pytest.approx(1.0)
    assert np.hypot(s0 - s1, c0 - c1) == pytest.approx(2 * np.sin(np.pi / 12))


# Published federal holidays and observed days.
@pytest.mark.parametrize(
    ("day", "gap"),
    [
        ("2024-01-01", 0), ("2024-01-02", 13), ("2024-01-16", 34), ("2024-02-20", 97), ("2024-05-28", 22),
        ("2024-06-20", 14), ("2024-07-05", 59), ("2024-09-03", 41), ("2024-10-15", 27), ("2024-11-12", 16),
        ("2024-11-29", 26), ("2024-12-26", 6), ("2021-12-26", 5), ("2021-12-30", 1), ("2022-12-26", 0),
        ("2022-12-27", 5), ("2023-01-02", 0), ("2020-06-18", 15), ("2021-06-17", 1), ("1985-01-02", 47),
    ],
)
def test_days_to_next_holiday(spark, day, gap):
    row = spark.range(1).select(calendar.days_to_next_holiday(F.lit(day).cast("date")).alias("g")).first()
    assert row["g"] == gap
