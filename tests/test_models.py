from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from odflow.operators import serving
from odflow.operators import validation as val
from odflow.operators.explore import _order_statistics, exact_quantiles, histogram
from odflow.operators.boosting import QuantileBoost
from odflow.operators.forest import QuantileForest
from odflow.operators.quality import assert_clean, observed_checks, report, watch
from odflow.operators.seasonal import seasonal_forecast
from odflow.operators.sequences import sequence_windows
from odflow.plans.features import build_features, feature_table
from odflow.plans.forecast import answer_requests
from odflow.plans.training import _part, ablation, cross_validate, train_forest
from odflow.session import materialise
from odflow.sources import tables

START = dt.datetime(2024, 1, 1)


def at(i):
    return START + dt.timedelta(hours=i)


@pytest.fixture(scope="module")
def stored(spark):
    """One route between zones 10 and 20 over 170 hours."""
    n = 170
    demand = spark.createDataFrame([(132, at(i), 10 + i, 300.0 + i) for i in range(n)], tables.DEMAND)
    routes = spark.createDataFrame([(132, 10, 20)], tables.ROUTES)
    rows = [(z, at(i), base + i * 0.01, 15 + i, False) for i in range(n) for z, base in ((10, 0.5), (20, 0.6))]
    return demand, routes, spark.createDataFrame(rows, tables.CONGESTION)


def test_build_features_writes_all_training_columns(spark, stored, tmp_path):
    for name, df in zip(("demand", "routes", "congestion"), stored):
        df.write.parquet(f"{tmp_path}/{name}")
    build_features(spark, str(tmp_path), f"{tmp_path}/features", F.lit("2024-01-31"))
    got = tables.read_features(spark, f"{tmp_path}/features", "2024-01-31")
    assert not set(val.TRAINING_FEATURES) - set(got.columns)
    assert got.count() == 170 and got.dropna("any").count() == 170
    assert len(got.columns) == 46


def test_leak_and_empty_columns_are_reported(spark, stored):
    demand, routes, congestion = stored
    features = feature_table(demand, routes, congestion)
    assert_clean(report(features, congestion))
    leaky = features.withColumn("origin_delay_index_lag1", F.col("origin_travel_time_var"))
    with pytest.raises(AssertionError, match="leakage"):
        assert_clean(report(leaky, congestion))
    empty = features.withColumn("dest_delay_index_lag1", F.lit(None).cast("double"))
    with pytest.raises(AssertionError, match="all_null dest_delay_index_lag1"):
        assert_clean(report(empty, congestion))


def test_checks_taken_while_writing_equal_those_of_a_pass(spark, stored):
    demand, routes, congestion = stored
    plan = feature_table(demand, routes, congestion)
    observation = Observation()
    features = materialise(watch(plan, demand, observation))
    assert features.columns == plan.columns
    order = ["check", "subject"]
    plain = report(features, congestion).orderBy(order).collect()
    assert report(features, congestion, observation).orderBy(order).collect() == plain
    # the metrics are constants by now: no file of the feature table is read for them
    assert "FileScan" not in observed_checks(features, observation)._jdf.queryExecution().toString()


def test_checks_of_an_empty_feature_table(spark, stored):
    demand, routes, congestion = stored
    observation = Observation()
    plan = feature_table(demand, routes.filter("route_id < 0"), congestion)
    features = materialise(watch(plan, demand, observation))
    got = {r["subject"]: r["value"] for r in report(features, congestion, observation).collect() if r["check"] == "rows"}
    assert got == {"features": 0.0}


def test_split_drops_the_boundary_hour(spark):
    rows = [(r, at(i), 10.0) for i in range(10) for r in (101, 202)]
    df = spark.createDataFrame(rows, "route_id int, hour timestamp_ntz, volume double")
    train, valid = val.time_split(df, ["route_id"], check=True)
    assert train.agg(F.max("hour")).first()[0] == at(7) and valid.agg(F.min("hour")).first()[0] == at(9)
    assert train.count() + valid.count() == df.count() - 2
    with pytest.raises(ValueError, match="missing"):
        val.time_split(df)
    with pytest.raises(ValueError, match="two distinct"):
        val.time_split(df.filter(F.col("hour") == at(0)), ["route_id"], check=True)
    with pytest.raises(ValueError, match="empty"):
        val.time_split(df.filter(F.col("hour") < at(2)), ["route_id"], check=True)


def test_folds_are_expanding_with_a_gap_in_rows(spark):
    rows = [(r, at(i), 1.0) for i in range(50) for r in (1, 2)]
    df = spark.createDataFrame(rows, "route_id int, hour timestamp_ntz, volume double").orderBy(F.rand(1))
    got = val.walk_forward(val.row_index(df), folds=3, gap=5).toPandas()
    size = 100 // 4
    for fold in range(3):
        part, start = got[got.fold == fold], 100 - (3 - fold) * size
        assert sorted(part[part.role == "test"].row_idx) == list(range(start, start + size))
        assert sorted(part[part.role == "train"].row_idx) == list(range(start - 5))


def test_gap_longer_than_the_first_fold(spark):
    df = spark.createDataFrame([(1, at(i), 1.0) for i in range(40)], "route_id int, hour timestamp_ntz, volume double")
    got = val.walk_forward(df, folds=3, gap=15).groupBy("fold", "role").count().collect()
    assert {(r["fold"], r["role"]): r["count"] for r in got} == {
        (0, "test"): 10, (1, "train"): 5, (1, "test"): 10, (2, "train"): 15, (2, "test"): 10
    }


def test_fold_filters_match_the_labelled_rows(noisy):
    labelled = val.walk_forward(noisy, folds=3, gap=7)
    for bounds in val.fold_bounds(noisy, folds=3, gap=7).collect():
        for role in ("train", "test"):
            want = labelled.filter((F.col("fold") == bounds["fold"]) & (F.col("role") == role)).drop("fold", "role")
            assert _part(noisy, bounds, role).exceptAll(want).count() == 0
            assert want.exceptAll(_part(noisy, bounds, role)).count() == 0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [("m", 10.0, 8.0, 10.0, 12.0), ("m", 20.0, 8.0, 10.0, 12.0)], "model string, volume double, p10 double, p50 double, p90 double"
    )
    got = val.quantile_metrics(df, ["model"]).first()
    assert got["p10"] == pytest.approx((0.2 + 1.2) / 2) and got["p50"] == pytest.approx(2.5)
    assert got["p90"] == pytest.approx((0.2 + 7.2) / 2) and got["coverage_80pct"] == 0.5
    point = val.point_metrics(df, ["model"]).first()
    assert point["mae"] == 5.0 and point["rmse"] == pytest.approx(50**0.5)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1200):
        x = float(i % 24)
        rows.append((1 + i % 2, at(i // 2), x, float(rng.normal()), int(rng.poisson(5 + 2 * x))))
    return spark.createDataFrame(rows, "route_id int, hour timestamp_ntz, x double, z double, volume int")


def test_forest_quantiles(spark, noisy, tmp_path):
    model = QuantileForest(features=["x", "z"], trees=10, depth=5)
    with pytest.raises(RuntimeError):
        model.predict(noisy)
    out = model.fit(noisy).predict(noisy)
    assert out.columns == [*noisy.columns, "p10", "p50", "p90"]
    assert out.filter((F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90"))).count() == 0
    metrics = val.quantile_metrics(out.withColumn("m", F.lit(1)), ["m"]).first()
    assert 0.7 < metrics["coverage_80pct"] <= 0.95
    naive = noisy.agg(*[F.percentile("volume", q).alias(n) for n, q in val.QUANTILES.items()]).first()
    flat = noisy.withColumns({n: F.lit(naive[n]) for n in val.QUANTILES}).withColumn("m", F.lit(1))
    assert metrics["p50"] < 0.6 * val.quantile_metrics(flat, ["m"]).first()["p50"]

    model.save(f"{tmp_path}/model", spark)
    again = QuantileForest.load(f"{tmp_path}/model", spark).predict(noisy)
    keys = ["route_id", "hour", "x"]
    gaps = val.within(val.max_difference(out, again, keys, list(val.QUANTILES)))
    assert all(r["ok"] and r["max_abs_diff"] == 0.0 for r in gaps.collect())


def test_forest_predicts_by_projection_only(noisy):
    model = QuantileForest(features=["x", "z"], trees=5, depth=3).fit(noisy)
    plan = model.predict(noisy)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "from_json" not in plan


def test_boosted_levels_beat_the_forest_and_stop_early(spark, noisy, tmp_path):
    late = F.col("hour") >= at(450)
    train, valid = noisy.filter(~late), noisy.filter(late)
    names = ["x", "z"]
    with pytest.raises(RuntimeError):
        QuantileBoost(features=names).predict(noisy)
    with pytest.raises(ValueError, match="depth"):
        QuantileBoost(features=names, depth=20)
    with pytest.raises(ValueError, match="no training rows"):
        QuantileBoost(features=names).fit(noisy.limit(0))
    model = QuantileBoost(features=names, rounds=14, depth=3, rate=0.4, patience=2, min_rows=20).fit(train, valid)
    assert set(model.best_rounds) == set(val.QUANTILES)
    assert min(model.best_rounds.values()) < 14  # one level at least stopped before the last round
    out = model.predict(valid)
    assert out.columns == [*noisy.columns, "p10", "p50", "p90"] and out.count() == valid.count()
    assert out.filter((F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90"))).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan  # only the leaf values come from elsewhere

    def losses(df):
        return val.quantile_metrics(df.withColumn("m", F.lit(1)), ["m"]).first()

    forest = QuantileForest(features=names, trees=10, depth=5).fit(train)
    mine, other = losses(out), losses(forest.predict(valid))
    assert mine["p10"] < other["p10"] and mine["p90"] < other["p90"]
    assert 0.65 < mine["coverage_80pct"] < 0.95

    model.save(f"{tmp_path}/boost", spark)
    again = QuantileBoost.load(f"{tmp_path}/boost", spark).predict(valid)
    gaps = val.within(val.max_difference(out, again, ["route_id", "hour", "x"], list(val.QUANTILES)))
    assert all(r["ok"] and r["max_abs_diff"] == 0.0 for r in gaps.collect())


def test_cross_validation(noisy):
    got = cross_validate(noisy, ["x", "z"], folds=2, gap=24, trees=5, depth=4).orderBy("fold").collect()
    assert [r["fold"] for r in got] == [0, 1]
    assert all(0 <= r["coverage_80pct"] <= 1 and r["p50"] > 0 for r in got)


def test_quantiles_are_exact_on_skewed_values(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.zeros(20_000), rng.pareto(1.1, 40_000) * 10])
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(values)], "v double")
    levels = [0.0, 0.3, 0.5, 0.9, 0.95, 0.99, 1.0]
    got = [r["value"] for r in exact_quantiles(df, "v", levels, accuracy=500).orderBy("quantile").collect()]
    np.testing.assert_allclose(got, np.quantile(values, levels), rtol=1e-12)


def test_a_missed_bracket_is_an_error(spark):
    values = spark.range(100).select(F.col("id").cast("double").alias("v"))
    bounds = F.array(F.struct(
        F.lit(0).alias("level"), F.lit(0.5).alias("quantile"), F.lit(100).alias("n"),
        F.lit(60.0).alias("low"), F.lit(70.0).alias("high"),
    ))
    with pytest.raises(Exception, match="outside its bracket"):
        _order_statistics(values, bounds).collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 10)], "v double")
    assert {r["bin"]: r["count"] for r in histogram(df, "v", 5).collect()} == {0: 2, 1: 2, 4: 1}
    assert {r["bin"]: r["count"] for r in histogram(df.filter("v = 10"), "v", 5).collect()} == {0: 1}


def test_seasonal_forecast_repeats_a_clean_week(spark):
    shape = [10 + (h % 24) + (5 if h // 24 >= 5 else 0) for h in range(168)]
    rows = [(1, at(i), shape[i % 168] + 0.01 * i) for i in range(168 * 6)]
    df = spark.createDataFrame(rows, "route_id int, hour timestamp_ntz, volume double")
    got = seasonal_forecast(df).orderBy("hour").collect()
    assert [r["hour"] for r in got] == [at(168 * 6 + k) for k in range(168)]
    want = [shape[k % 168] + 0.01 * (168 * 6 + k) for k in range(168)]
    np.testing.assert_allclose([r["forecast"] for r in got], want, atol=0.9)


def test_sequences(spark):
    df = spark.createDataFrame([(1, at(i), i, i * 2) for i in range(12)], "route_id int, hour timestamp_ntz, time_idx int, volume int")
    got = sequence_windows(df, encoder=6, horizon=3, known=["time_idx"], unknown=["volume"]).orderBy("time_idx").collect()
    assert [r["time_idx"] for r in got] == list(range(2, 11))
    assert [s["volume"] for s in got[5]["past"]] == [4, 6, 8, 10, 12, 14]
    assert [s["volume"] for s in got[5]["future"]] == [16, 18, 20]
    last = sequence_windows(df, 6, 3, ["time_idx"], ["volume"], last_only=True).collect()
    assert [r["time_idx"] for r in last] == [8]


def test_sequences_equal_plain_slices(spark):
    """Blocks, strides and short routes against list slices; the newest complete window is always among them."""
    lengths = {1: 41, 2: 9, 3: 4, 4: 3, 5: 1}
    rows = [(r, at(i), i, 100 * r + i) for r, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "route_id int, hour timestamp_ntz, time_idx int, volume int")
    encoder, horizon = 7, 4
    newest = {r: max(n - horizon, encoder // 2) - 1 for r, n in lengths.items()}

    def want(keep):
        out = {}
        for r, n in lengths.items():
            v = [100 * r + i for i in range(n)]
            for e in range(encoder // 2 - 1, n - 1):
                if keep(r, e):
                    out[r, e] = (v[max(e - encoder + 1, 0) : e + 1], v[e + 1 : e + 1 + horizon])
        return out

    def got(**options):
        windows = sequence_windows(df, encoder, horizon, ["time_idx"], ["volume"], **options).collect()
        return {
            (w["route_id"], w["time_idx"]): ([s["volume"] for s in w["past"]], [s["volume"] for s in w["future"]])
            for w in windows
            if w["hour"] == at(w["time_idx"]) and (w["past_rows"], w["future_rows"]) == (len(w["past"]), len(w["future"]))
        }

    assert got() == want(lambda r, e: True)
    assert got(stride=3) == want(lambda r, e: (newest[r] - e) % 3 == 0)
    assert got(last_only=True) == want(lambda r, e: e == newest[r])


def history(spark, values, zone_values, samples=15):
    demand = spark.createDataFrame([(1, at(i), int(v), None) for i, v in enumerate(values)], tables.DEMAND)
    rows = [(z, at(i), float(v), samples, False) for z in (5, 6) for i, v in enumerate(zone_values)]
    congestion = spark.createDataFrame(rows, tables.CONGESTION)
    routes = spark.createDataFrame([(1, 5, 6)], tables.ROUTES)
    return routes, demand, congestion


def test_serving_full_history(spark):
    got = serving.static_features(*history(spark, range(168), [0.5] * 168)).first()
    assert (got["lag_1h"], got["lag_2h"], got["lag_168h"]) == (167.0, 166.0, 0.0)
    assert got["rolling_mean_3h"] == 166.0 and got["rolling_mean_168h"] == 83.5
    e24 = e168 = 0.0
    for v in range(1, 168):
        e24, e168 = e24 + 2 / 25 * (v - e24), e168 + 2 / 169 * (v - e168)
    assert got["ewm_trend_24h"] == pytest.approx(e24) and got["ewm_trend_168h"] == pytest.approx(e168)
    assert got["origin_disruption_flag"] == 0.0 and got["origin_low_confidence_flag"] == 0.0
    assert got["yoy_ratio"] == 0.0 and got["duration_lag_1h"] == 0.0


def test_serving_partial_history(spark):
    got = serving.static_features(*history(spark, [50] * 10, [0.1, 0.2, 0.3], samples=5)).first()
    assert (got["lag_6h"], got["lag_12h"], got["rolling_mean_168h"]) == (50.0, 0.0, 50.0)
    assert got["dest_delay_index_lag1"] == 0.3 and got["dest_delay_index_lag24"] == 0.0
    assert got["dest_delay_index_rolling3h"] == pytest.approx(0.2) and got["origin_low_confidence_flag"] == 1.0


def test_serving_flag_uses_population_deviation(spark):
    got = serving.static_features(*history(spark, [1], [1.0] * 167 + [9.0])).first()
    assert got["origin_disruption_flag"] == 1.0 and got["origin_delay_index"] == 9.0


def test_serving_without_history(spark):
    routes, demand, congestion = history(spark, [1], [1.0])
    got = serving.static_features(routes, demand.limit(0), congestion.limit(0))
    matrix = serving.horizon_matrix(got, 24, F.lit(START).cast("timestamp_ntz"))
    assert matrix.columns == serving.SERVING_FEATURES and len(matrix.columns) == 54
    assert {t for c, t in matrix.dtypes if c != "route_id"} == {"float"}
    rows = matrix.orderBy("horizon_hours").collect()
    assert [r["horizon_hours"] for r in rows] == list(range(1, 25))
    assert rows[0]["lag_1h"] == 0.0 and rows[0]["hour_of_day"] == 1.0 and rows[23]["hour_of_day"] == 0.0


def test_answers(spark):
    routes, demand, congestion = history(spark, range(168), [14.0] * 168)

    class Flat:
        def predict(self, df):
            return df.withColumns({"p10": F.lit(1.0), "p50": F.col("horizon_hours"), "p90": F.col("dow")})

    asked = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (2, 1), (1, 9)], "route_id int, horizon int")
    answered, rejected = answer_requests(
        asked, Flat(), routes, demand, congestion, F.lit(START).cast("timestamp_ntz")
    )
    got = {r["horizon"]: r for r in answered.collect()}
    assert sorted(got) == [1, 3] and rejected.count() == 2
    assert len(got[3]["p10"]) == 72 and got[3]["p50"] == [float(k) for k in range(1, 73)]
    assert got[1]["forecast_key"] == "forecast:1:1:10.0"
    assert got[1]["p90"][0] == 1.0  # Monday is 1 for the model


def test_ablation_and_final_model(spark):
    rng = np.random.default_rng(5)
    rows = [(r, at(i), int(rng.poisson(20))) for i in range(300) for r in (1, 2)]
    base = spark.createDataFrame(rows, "route_id int, hour timestamp_ntz, volume int")
    others = [c for c in val.TRAINING_FEATURES if c != "route_id"]
    df = base.withColumns({c: F.rand(i) for i, c in enumerate(others)})
    got = ablation(df, folds=2, trees=3, depth=2).collect()
    assert {(r["model"], r["metric"]) for r in got} == {
        (m, k) for m in ("full", "no_congestion") for k in ("p10", "p50", "p90", "coverage_80pct")
    }
    model = train_forest(df, trees=3, depth=2)
    assert model.features == val.TRAINING_FEATURES and len(model.features) == 31
