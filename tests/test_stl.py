from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflow.operators import stl
from odflow.operators.seasonal import seasonal_forecast
from odflow.session import materialise

START = dt.datetime(2024, 1, 1)
DEMAND = "route_id int, hour timestamp_ntz, volume double"


def brute_line(xs, vs, ws, at, half):
    d = (xs - at) / half
    k = np.where(np.abs(d) < 1, ws * (1 - np.abs(d) ** 3) ** 3, 0.0)
    if (k * d * d).sum() * k.sum() - (k * d).sum() ** 2 <= 1e-9 * k.sum() ** 2:
        return (k * vs).sum() / k.sum()
    slope, level = np.polyfit(d[k > 0], vs[k > 0], 1, w=np.sqrt(k[k > 0]))
    return level


def test_lines_equal_weighted_least_squares(spark):
    rng = np.random.default_rng(3)
    xs = np.sort(rng.choice(300, 120, replace=False))
    vs, ws = rng.normal(size=120) + 0.05 * xs, rng.uniform(0.1, 1, 120)
    rows = [(1, int(x), float(v), float(w)) for x, v, w in zip(xs, vs, ws)] + [(1, 50, None, 1.0), (2, 7, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "route_id int, x long, v double, w double")
    got = stl.local_lines(df, ["route_id"], "x", "v", 40, 8, "w").collect()
    assert {r["anchor"] for r in got if r["route_id"] == 2} == set(range(-4, 6))
    for r in got:
        if r["route_id"] == 1:
            assert r["line"] == pytest.approx(brute_line(xs, vs, ws, r["anchor"] * 8, 40), rel=1e-7, abs=1e-7)
        else:
            assert r["line"] == pytest.approx(4.0)


def test_a_straight_line_is_its_own_smooth(spark):
    df = spark.range(200).select(F.lit(1).alias("route_id"), F.col("id").alias("x"), (3.0 + 0.5 * F.col("id")).alias("v"))
    off = stl.smooth(df, "route_id", "x", "v", 48, 24, "s").agg(F.max(F.abs(F.col("s") - F.col("v")))).first()[0]
    assert off < 1e-9
    with pytest.raises(ValueError, match="closer"):
        stl.smooth(df, "route_id", "x", "v", 24, 24, "s")


def season(h):
    return 6 * np.sin(2 * np.pi * (h % 24) / 24) + 3 * (h // 24 % 7 >= 5)


@pytest.fixture(scope="module")
def bent(spark):
    """Ten weeks whose trend turns, with outliers and missing hours, and the week after."""
    rng, rows, after = np.random.default_rng(8), [], []
    for h in range(11 * 168):
        level = 40 + (0.02 * h if h < 1000 else 20 - 0.01 * (h - 1000))
        v = level + season(h) + rng.normal(0, 0.5)
        if h >= 10 * 168:
            after.append((1, START + dt.timedelta(hours=h), float(v)))
        elif h % 97:
            rows.append((1, START + dt.timedelta(hours=h), float(v + (200 if h % 131 == 0 else 0))))
    return spark.createDataFrame(rows, DEMAND), spark.createDataFrame(after, DEMAND)


@pytest.fixture(scope="module")
def parts(bent):
    return materialise(stl.stl(bent[0]))


def test_parts_add_up_and_outliers_lose_their_weight(bent, parts):
    got = parts.toPandas()
    assert len(got) == bent[0].count() and not got.isna().any().any()
    assert np.allclose(got.season + got.trend + got.remainder, got.volume)
    odd = got.remainder > 100
    assert odd.sum() > 8 and got.weight[odd].max() < 1e-3 and got.weight[~odd].median() > 0.5
    hours = ((got.hour - np.datetime64(START)) / np.timedelta64(1, "h")).astype(int)
    truth = season(hours.to_numpy()) - np.mean(season(np.arange(168)))
    assert np.abs(got.season - truth).mean() < 0.4


def test_forecasts_beat_the_profile_baseline(bent, parts):
    past, after = bent

    def loss(f):
        return after.join(f, ["route_id", "hour"]).agg(F.avg(F.abs(F.col("volume") - F.col("forecast")))).first()[0]

    assert stl.season_worth(parts).first()["worth"] > 0.6
    assert loss(stl.stl_forecast(parts)) < 0.6 * loss(seasonal_forecast(past))


def test_short_and_empty_series(spark):
    rows = [(1, START, 5.0), (2, START, 1.0), (2, START + dt.timedelta(hours=1), 3.0), (3, START, None), (3, None, 1.0)]
    df = spark.createDataFrame(rows, DEMAND)
    parts = materialise(stl.stl(df, outer=1))
    got = {(r["route_id"], r["hour"]): r for r in parts.collect()}
    assert len(got) == 3 and got[(1, START)]["season"] + got[(1, START)]["trend"] == pytest.approx(5.0)
    assert stl.stl_forecast(parts, 3).count() == 6
    assert stl.stl(df.limit(0), outer=1).count() == 0
