from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflow.operators import bootstrap
from odflow.operators.gaps import gap_days, gap_ranges
from odflow.plans import ingest
from odflow.sources.tables import read_table

START = dt.datetime(2024, 1, 1)


def at(h, minute=0):
    return START + dt.timedelta(hours=h, minutes=minute)


def test_gaps_lie_between_the_hours_of_a_key(spark):
    rows = [(1, at(0)), (1, at(0, 30)), (1, at(1)), (1, at(5, 59)), (1, at(6)), (1, at(8)), (2, at(3)), (None, at(1)), (3, None)]
    seen = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    got = {tuple(r) for r in gap_ranges(seen, "k", ts="ts").collect()}
    assert got == {(1, at(2), at(4), 3), (1, at(7), at(7), 1)}
    span = spark.createDataFrame([(at(-2), at(9, 15))], "start timestamp_ntz, end timestamp_ntz")
    got = {tuple(r) for r in gap_ranges(seen, "k", span, "ts").collect()}
    assert got == {
        (1, at(-2), at(-1), 2), (1, at(2), at(4), 3), (1, at(7), at(7), 1), (1, at(9), at(9), 1),
        (2, at(-2), at(2), 5), (2, at(4), at(9), 6),
    }
    assert gap_ranges(seen.limit(0), "k", ts="ts").count() == 0


def test_gaps_over_midnight_touch_both_days(spark):
    rows = [(at(20), at(26), 7), (at(30), at(30), 1)]
    gaps = spark.createDataFrame(rows, "start timestamp_ntz, end timestamp_ntz, hours long")
    assert sorted(r["day"].day for r in gap_days(gaps, 2).collect()) == [1, 2]
    assert gap_days(gaps, 8).count() == 0


def test_backfill_finds_a_day_that_lacks_hours(spark, tmp_path):
    """A day with a few rows is present for whole-day checks, but not for gaps."""
    square = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    edges = spark.createDataFrame([(7, *map(float, e)) for e in square], "zone_id int, x1 double, y1 double, x2 double, y2 double")
    rows = [(at(h, m), 0.5, 0.5, float(h + m)) for h in range(48) for m in (0, 10)]
    samples = spark.createDataFrame(rows, "hour timestamp_ntz, longitude double, latitude double, segment_travel_time double")
    samples = samples.withColumn("timestamp", F.col("hour"))
    first = samples.filter((F.col("hour") < F.lit(at(24))) | (F.col("hour") >= F.lit(at(40))))
    ingest.ingest_positions(spark, first, edges, str(tmp_path), size=0.5)
    span = spark.createDataFrame([(START.date(), at(24).date())], "start date, end date")
    ingest.backfill_positions(spark, samples, edges, span, str(tmp_path), size=0.5)
    assert read_table(spark, str(tmp_path), "congestion").count() == 32
    ingest.backfill_positions(spark, samples, edges, span, str(tmp_path), size=0.5, least_hours=6)
    assert read_table(spark, str(tmp_path), "congestion").count() == 48


def forecasts(spark, shift, noise, seed):
    rng, rows = np.random.default_rng(0), []
    own = np.random.default_rng(seed)
    for h in range(40 * 24):
        y = float(rng.poisson(20))
        m = 20 + shift + noise * own.normal()
        rows.append((1, at(h), y, m - 5, float(m), m + 5))
    return spark.createDataFrame(rows, "route_id int, hour timestamp_ntz, volume double, p10 double, p50 double, p90 double")


def test_a_real_difference_is_told_from_chance(spark):
    good = forecasts(spark, 0, 0.2, 1)
    worse = {r["metric"]: r for r in bootstrap.loss_difference(good, forecasts(spark, 6, 0.2, 2), replicates=300).collect()}
    assert worse["p50"]["real"] and worse["p50"]["high"] < 0 and worse["p50"]["days"] == 40
    same = {r["metric"]: r for r in bootstrap.loss_difference(good, forecasts(spark, 0, 0.2, 3), replicates=300).collect()}
    assert not same["p50"]["real"] and same["p50"]["low"] < 0 < same["p50"]["high"]
    again = bootstrap.loss_difference(good.repartition(7), forecasts(spark, 0, 0.2, 3).repartition(3), replicates=300)
    for r in again.collect():
        assert (r["low"], r["high"]) == (pytest.approx(same[r["metric"]]["low"]), pytest.approx(same[r["metric"]]["high"]))


def test_draws_are_poisson_and_the_spread_is_that_of_the_mean(spark):
    draws = spark.range(20000).select(bootstrap.poisson(bootstrap.uniform(F.col("id"))).alias("t"))
    mean, var = draws.agg(F.avg("t"), F.var_samp("t")).first()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.06
    rng = np.random.default_rng(5)
    days = [("p50", START.date() + dt.timedelta(days=i), float(v), 1) for i, v in enumerate(rng.normal(0, 1, 400))]
    daily = spark.createDataFrame(days, "metric string, day date, difference double, n long")
    spread = bootstrap.replicate_means(daily, 500).agg(F.stddev("mean")).first()[0]
    assert spread == pytest.approx(1 / np.sqrt(400), rel=0.15)


def test_nulls_and_one_sided_rows_are_left_out(spark):
    schema = "route_id int, hour timestamp_ntz, volume double, p10 double, p50 double, p90 double"
    left = spark.createDataFrame([(1, at(0), 5.0, 1.0, 5.0, 9.0), (1, at(1), None, 1.0, 5.0, 9.0), (1, at(2), 5.0, 1.0, 5.0, 9.0)], schema)
    right = spark.createDataFrame([(1, at(0), 5.0, 1.0, None, 9.0), (1, at(1), 5.0, 1.0, 4.0, 9.0)], schema)
    got = {r["metric"]: r["rows"] for r in bootstrap.loss_difference(left, right, replicates=50).collect()}
    assert got == {"p10": 1, "p90": 1}
