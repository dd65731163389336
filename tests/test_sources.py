from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from odflow.functions import scalars
from odflow.operators import congestion as signals
from odflow.operators import demand as od
from odflow.plans import ingest
from odflow.session import small_side
from odflow.sources import tables, trips, upserts

T = dt.datetime
TRIPS = "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID bigint, DOLocationID bigint, color string"


def trip(start, minutes, pu=1, do=2, color="yellow"):
    return (start, start + dt.timedelta(minutes=minutes), pu, do, color)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_month_range():
    assert trips.month_range(dt.date(2024, 3, 15), 4) == [(2024, 2), (2024, 1), (2023, 12), (2023, 11)]


def test_hourly_pairs(spark):
    data = [trip(T(2024, 3, 7, 14, 5), 10), trip(T(2024, 3, 7, 14, 45), 20), trip(T(2024, 3, 7, 15, 10), 10),
            trip(T(2024, 3, 7, 14, 20), -5, 2, 3)]
    got = rows(od.hourly_pairs(spark.createDataFrame(data, TRIPS)), "PULocationID", "hour")
    assert got == [(1, 2, T(2024, 3, 7, 14), 2, 900.0), (1, 2, T(2024, 3, 7, 15), 1, 600.0),
                   (2, 3, T(2024, 3, 7, 14), 1, 0.0)]


def test_missing_or_null_dropoff(spark):
    df = spark.createDataFrame([(T(2024, 1, 1), None, 1, 2, "green")], TRIPS)
    assert od.hourly_pairs(df).first()["avg_duration"] is None
    assert od.hourly_pairs(df.drop("dropoff_datetime")).first()["avg_duration"] == 0.0
    assert od.hourly_pairs(df.limit(0)).dtypes == od.hourly_pairs(df).dtypes


def test_colors_are_averaged_without_weights(spark):
    data = [trip(T(2024, 1, 1), 10), trip(T(2024, 1, 1), 20), trip(T(2024, 1, 1), 60, color="green")]
    df = spark.createDataFrame(data, TRIPS)
    plain = od.combined_pairs(df, ["yellow", "green"]).first()
    assert (plain["pickup_count"], plain["avg_duration"]) == (3, (900 + 3600) / 2)
    assert od.combined_pairs(df, ["yellow", "green"], weighted=True).first()["avg_duration"] == 1800.0


def write_month(spark, folder, color, year, month, data):
    prefix = "tpep" if color == "yellow" else "lpep"
    df = spark.createDataFrame(data, TRIPS).drop("color").withColumn("trip_distance", F.lit(1.0))
    df = df.withColumnsRenamed(
        {"pickup_datetime": f"{prefix}_pickup_datetime", "dropoff_datetime": f"{prefix}_dropoff_datetime"}
    ).withColumn("tip_amount", F.lit(1.0))
    df.coalesce(1).write.parquet(f"{folder}/{color}_tripdata_{year}-{month:02d}.parquet")


@pytest.fixture(scope="module")
def trip_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("trips"))
    write_month(spark, folder, "yellow", 2024, 2, [trip(T(2024, 2, 29, 23), 10), trip(T(2024, 3, 1), 10)])
    write_month(spark, folder, "green", 2024, 2, [trip(T(2024, 2, 29, 23, 30), 30, color="green"), trip(T(2009, 1, 1), 5)])
    return folder


def pinned_names(folder):
    """A directory counts as a file: its part files carry no month in their names."""
    import glob
    import os
    import shutil

    out = f"{folder}-files"
    if not os.path.isdir(out):
        os.makedirs(out)
        for path in glob.glob(f"{folder}/*.parquet"):
            (part,) = glob.glob(f"{path}/part-*.parquet")
            shutil.copy(part, f"{out}/{os.path.basename(path)}")
    return out


def test_scan_keeps_each_files_month(spark, trip_folder):
    folder = pinned_names(trip_folder)
    got = trips.scan(spark, folder, ["yellow", "green"], trips.month_range(dt.date(2024, 3, 1), 3))
    assert set(got.columns) == {"pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID",
                                "trip_distance", "color"}
    assert sorted(r["color"] for r in got.collect()) == ["green", "yellow"]
    assert "PushedFilters: [" in plan(got) and "GreaterThanOrEqual(tpep_pickup_datetime" in plan(got)
    assert "tip_amount" not in plan(got)


def test_scan_reads_narrow_and_wide_ids(spark, tmp_path):
    rows = [(T(2024, 1, 5), T(2024, 1, 5, 1), 7)]
    columns = "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID {0}"
    for month, kind in ((1, "int"), (2, "bigint")):
        df = spark.createDataFrame(rows, columns.format(kind)).withColumn("DOLocationID", F.lit(8).cast(kind))
        if month == 2:
            df = df.withColumn("tpep_pickup_datetime", F.lit("2024-02-05").cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(f"{tmp_path}/yellow_tripdata_2024-{month:02d}.parquet")
    folder = pinned_names(str(tmp_path))
    got = trips.scan(spark, folder, ["yellow"], [(2024, 2), (2024, 1)])
    assert dict(got.dtypes)["PULocationID"] == "bigint" and got.count() == 2
    assert {r["PULocationID"] for r in got.collect()} == {7}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_writes_known_routes_once(spark, trip_folder, tmp_path):
    warehouse = str(tmp_path)
    spark.createDataFrame([(999, 1, 2)], tables.ROUTES).write.parquet(f"{warehouse}/routes")
    for _ in range(2):
        ingest.ingest_trips(spark, pinned_names(trip_folder), dt.date(2024, 3, 1), 3, warehouse=warehouse)
    got = rows(tables.read_table(spark, warehouse, "demand"), "hour")
    assert got == [(999, T(2024, 2, 29, 23), 2, (600 + 1800) / 2)]


def test_no_files(spark, tmp_path):
    empty = trips.scan(spark, str(tmp_path), ["yellow"], [(2024, 1)])
    assert od.combined_pairs(empty, ["yellow"]).count() == 0


def test_upsert_touches_only_its_days(spark, tmp_path):
    path = f"{tmp_path}/demand"
    first = spark.createDataFrame([(1, T(2024, 1, 1, 5), 3, 1.0), (1, T(2024, 1, 2, 5), 4, 1.0)], tables.DEMAND)
    again = spark.createDataFrame([(1, T(2024, 1, 2, 5), 9, 2.0), (2, T(2024, 1, 2, 6), 1, 2.0)], tables.DEMAND)
    for batch in (first, again, again):
        upserts.upsert(spark, path, batch, ["route_id", "hour"], F.col("hour"))
    got = rows(spark.read.parquet(path).drop("day"), "hour")
    assert got == [(1, T(2024, 1, 1, 5), 3, 1.0), (1, T(2024, 1, 2, 5), 9, 2.0), (2, T(2024, 1, 2, 6), 1, 2.0)]


def test_demand_rows(spark):
    hourly = spark.createDataFrame(
        [(1, 2, T(2024, 1, 1), 5, None), (7, 7, T(2024, 1, 1), 5, 1.0)],
        "PULocationID bigint, DOLocationID bigint, hour timestamp_ntz, pickup_count bigint, avg_duration double",
    )
    routes = spark.createDataFrame([(999, 1, 2), (1000, 10, 20)], tables.ROUTES)
    assert rows(upserts.demand_rows(hourly, routes), "route_id") == [(999, T(2024, 1, 1), 5, 0.0)]


def test_new_routes_by_volume(spark):
    stored = spark.createDataFrame([(5, 1, 2)], tables.ROUTES)
    picked = spark.createDataFrame(
        [(1, 2, 9.0), (3, 4, 2.0), (4, 3, 7.0), (2, 2, 2.0)],
        "PULocationID bigint, DOLocationID bigint, avg_monthly_volume double",
    )
    assert rows(upserts.new_routes(stored, picked), "route_id") == [(6, 4, 3), (7, 2, 2), (8, 3, 4)]
    assert upserts.new_routes(stored.limit(0), picked).agg({"route_id": "min"}).first()[0] == 1


def test_route_threshold_is_strict(spark):
    data = [trip(T(2024, 1, 1), 1)] * 3 + [trip(T(2024, 2, 1), 1, 5, 6)] * 4
    got = od.selected_routes(spark.createDataFrame(data, TRIPS), threshold=1.5)
    assert [(r["PULocationID"], r["avg_monthly_volume"]) for r in got.collect()] == [(5, 2.0)]


def test_weighted_delay_merge(spark):
    data = [(1, T(2024, 1, 1), "a", 60.0, 1), (1, T(2024, 1, 1), "a", 90.0, 2)]
    assert rows(upserts.merge_delays(spark.createDataFrame(data, tables.DELAYS)), "zone_id") == [
        (1, T(2024, 1, 1), "a", 80.0, 3)
    ]


def test_flag_updates_only_differences(spark):
    stored = spark.createDataFrame(
        [(1, T(2024, 1, 1), 1.0, 9, False), (2, T(2024, 1, 1), 1.0, 9, False), (3, T(2024, 1, 1), 1.0, 9, True)],
        tables.CONGESTION,
    )
    fresh = spark.createDataFrame(
        [(1, T(2024, 1, 1), 1), (2, T(2024, 1, 1), 0), (3, T(2024, 1, 1), None)],
        "zone_id int, hour timestamp_ntz, disruption_flag tinyint",
    )
    updates = upserts.flag_updates(stored, fresh)
    assert rows(updates, "zone_id") == [(1, T(2024, 1, 1), True)]
    applied = upserts.apply_flags(stored, updates).orderBy("zone_id").collect()
    assert [r["disruption_flag"] for r in applied] == [True, False, True]


def test_refresh_flags_on_disk(spark, tmp_path):
    path = f"{tmp_path}/congestion"
    hours = [(1, T(2024, 1, 1) + dt.timedelta(hours=i), float(i % 3), 9, False) for i in range(169)]
    hours.append((1, T(2024, 1, 1) + dt.timedelta(hours=169), 99.0, 9, False))
    upserts.upsert(spark, path, spark.createDataFrame(hours, tables.CONGESTION), ["zone_id", "hour"], F.col("hour"))
    assert ingest.refresh_flags(spark, str(tmp_path)).count() == 1
    stored = spark.read.parquet(path)
    assert stored.count() == 170 and stored.filter("disruption_flag").first()["travel_time_var"] == 99.0


def test_missing_days(spark):
    span = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 3))], "start date, end date")
    present = spark.createDataFrame([(T(2024, 1, 2, 9),)], "hour timestamp_ntz")
    assert rows(upserts.missing_days(span, present, "hour"), "day") == [(dt.date(2024, 1, 1),), (dt.date(2024, 1, 3),)]


def test_csv_stop_map(spark, tmp_path):
    path = tmp_path / "stops.csv"
    path.write_text("stop_id,zone_id,name\n101,220,a\n0102,221,b\n,3,c\nA1,,d\n")
    got = rows(tables.read_csv(spark, str(path), tables.STOP_MAP, ["stop_id", "zone_id"]), "stop_id")
    assert got == [("0102", 221), ("101", 220)]


def test_event_dates(spark, tmp_path):
    good = '[{"event_start_date": "2024-03-17T00:00:00.000"}, {"event_start_date": "x"}, {"a": 1},'
    (tmp_path / "a.json").write_text(good + '\n {"event_start_date": "20240520"}, {"event_start_date": "2024-03-17"}]')
    (tmp_path / "b.json").write_text('{"event_start_date": "2024-07-07"}')
    (tmp_path / "c.json").write_text("oops")
    got = rows(tables.read_event_dates(spark, str(tmp_path)), "event_date")
    assert got == [(dt.date(2024, 3, 17),), (dt.date(2024, 5, 20),)]


def test_snapshots_are_kept_apart(spark, tmp_path):
    path = f"{tmp_path}/features"
    for cutoff, n in (("2024-01-01", 3), ("2024-02-01", 2), ("2024-01-01", 1)):
        tables.write_features(spark.range(n), path, F.lit(cutoff))
    assert tables.read_features(spark, path, "2024-01-01").count() == 1
    assert tables.read_features(spark, path, "2024-02-01").count() == 2


def test_zone_variance(spark):
    data = [(1, T(2024, 1, 1, 10), 120.0), (1, T(2024, 1, 1, 10), 130.0), (1, T(2024, 1, 1, 10), 125.0),
            (2, T(2024, 1, 1, 11), 200.0), (2, T(2024, 1, 1, 11), None)]
    df = spark.createDataFrame(data, "zone_id int, hour timestamp_ntz, segment_travel_time double")
    assert [tuple(r)[2:] for r in signals.zone_variance(df).orderBy("zone_id").collect()] == [(25.0, 3), (0.0, 1)]


def test_positions_to_congestion(spark, tmp_path):
    square = [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0)]
    edges = [(z, a + dx, b, c + dx, d) for z, dx in ((1, 0.0), (2, 5.0)) for a, b, c, d in square]
    zones = spark.createDataFrame(edges, "zone_id int, x1 double, y1 double, x2 double, y2 double")
    data = [("2024-01-01 10:05:00", 0.5, 0.5, 120), ("2024-01-01 10:15:00", 0.5, 0.6, 130),
            ("2024-01-01 10:25:00", 0.4, 0.5, 125), ("2024-01-01 11:00:00", 0.5, 5.5, 200),
            ("2024-01-01 11:00:00", 0.5, 9.5, 999)]
    positions = spark.createDataFrame(data, "timestamp string, latitude double, longitude double, segment_travel_time int")
    got = ingest.ingest_positions(spark, positions, zones, str(tmp_path))
    want = [(1, T(2024, 1, 1, 10), 25.0, 3), (2, T(2024, 1, 1, 11), 0.0, 1)]
    assert rows(got, "zone_id") == want
    assert rows(tables.read_table(spark, str(tmp_path), "congestion"), "zone_id") == want

    more = [("2024-01-01 12:00:00", 0.5, 0.5, 1), ("2024-01-02 09:00:00", 0.5, 0.5, 5), ("2024-01-04 09:00:00", 0.5, 0.5, 5)]
    later = positions.unionByName(spark.createDataFrame(more, positions.schema))
    span = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 3))], "start date, end date")
    for fresh in (1, 0):  # only the missing day of the span is filled, and only once
        assert ingest.backfill_positions(spark, later, zones, span, str(tmp_path)).count() == fresh
        got = rows(tables.read_table(spark, str(tmp_path), "congestion"), "zone_id", "hour")
        assert got == [want[0], (1, T(2024, 1, 2, 9), 0.0, 1), want[1]]


def test_small_side_leaves_large_tables_to_the_planner(spark):
    big, small = small_side(spark.range(50), limit=49), small_side(spark.range(50), limit=50)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString()


def test_position_fallbacks(spark):
    base = spark.createDataFrame([("2024-01-01 10:20:00", 1.0, 2.0, 7)], "time string, latitude double, longitude double, travel_time int")
    got = signals.position_samples(base).first()
    assert got["segment_travel_time"] == 7 and got["hour"] == T(2024, 1, 1, 10)
    assert signals.position_samples(base.drop("travel_time")).first()["segment_travel_time"] == 0.0
    assert signals.position_samples(base.drop("latitude")).count() == 0
    with pytest.raises(ValueError):
        signals.position_samples(base.drop("time"))


def test_zone_delays(spark):
    delays = spark.createDataFrame(
        [("101N", 60.0, 1), ("101N", 120.0, 1), ("102S", 30.0, 1), ("UNKNOWN", 500.0, 1)], "stop_id string, delay double, feed_id int"
    )
    stops = spark.createDataFrame([("101N", 220), ("102S", 221), ("9", None)], tables.STOP_MAP)
    at = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    got = rows(signals.zone_delays(delays, stops, at), "zone_id")
    assert got == [(220, T(2024, 1, 1, 10), "1", 90.0, 2), (221, T(2024, 1, 1, 10), "1", 30.0, 1)]


def test_recent_delay_is_strict_and_defaults(spark):
    now = T(2024, 1, 1, 10)
    delays = spark.createDataFrame(
        [(1, now, "a", 60.0, 1), (1, now, "b", 90.0, 2), (1, T(2024, 1, 1, 9), "a", 900.0, 9)], tables.DELAYS
    )
    zones = spark.createDataFrame([(1,), (2,)], "zone_id int")
    got = rows(signals.recent_delay(delays, zones, F.lit(now).cast("timestamp_ntz")), "zone_id")
    assert got == [(1, 80.0), (2, 0.0)]


@pytest.mark.parametrize(
    ("value", "bucket"), [(14, 10), (16, 20), (25, 20), (35, 40), (24.9, 20), (-3, 0), (-7, -10), (999, 1000)]
)
def test_congestion_bucket(spark, value, bucket):
    row = spark.range(1).select(scalars.congestion_bucket(F.lit(float(value))).alias("b")).first()
    assert row["b"] == bucket


@pytest.mark.parametrize(
    ("value", "key"), [(13.0, "10.0"), (0.0, "0.0"), (-3.0, "0.0"), (12345678.0, "12345680.0"), (1e9, "1000000000.0")]
)
def test_forecast_key(spark, value, key):
    column = scalars.forecast_key(F.lit(132), F.lit(3), F.lit(value))
    assert spark.range(1).select(column).first()[0] == f"forecast:132:3:{key}"


def test_requests(spark):
    asked = spark.createDataFrame(
        [(1, 1), (1, 7), (1, 0), (1, 8), (1, -1), (0, 3), (-1, 3), (77, 3), (None, 3)], "route_id int, horizon int"
    )
    routes = spark.createDataFrame([(1, 5, 6)], tables.ROUTES)
    accepted, rejected = scalars.split_requests(asked, routes)
    assert rows(accepted, "horizon") == [(1, 1), (1, 7)]
    reasons = [r["reason"] for r in rejected.collect()]
    assert len(reasons) == 7 and reasons.count("route not found") == 1


def test_scan_keeps_columns_of_any_file_in_spark_folders(spark, tmp_path):
    base = "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID int"
    first = spark.createDataFrame([(T(2024, 1, 5), T(2024, 1, 5, 1), 7)], base)
    second = spark.createDataFrame([(T(2024, 2, 5), T(2024, 2, 5, 1), 8, 2.5)], base + ", trip_distance double")
    first.write.parquet(f"{tmp_path}/yellow_tripdata_2024-01.parquet")
    second.write.parquet(f"{tmp_path}/yellow_tripdata_2024-02.parquet")
    months = [(2024, 3), (2024, 2), (2024, 1)]
    for order in (months, months[::-1]):
        got = trips.scan(spark, str(tmp_path), ["yellow"], order)
        assert sorted((r["PULocationID"], r["trip_distance"]) for r in got.collect()) == [(7, None), (8, 2.5)]
    assert [p[-15:] for p in trips.missing_files(spark, str(tmp_path), ["yellow"], months)] == ["2024-03.parquet"]


def test_scan_leaves_out_unreadable_files_whole(spark, tmp_path):
    base = "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID int"
    spark.createDataFrame([(T(2024, 1, 5), T(2024, 1, 5, 1), 7)], base).write.parquet(f"{tmp_path}/yellow_tripdata_2024-01.parquet")
    (tmp_path / "yellow_tripdata_2024-02.parquet").write_bytes(b"PAR1 not a file PAR1")
    months = [(2024, 2), (2024, 1)]
    assert trips.scan(spark, str(tmp_path), ["yellow"], months, skip_unreadable=True).count() == 1
    with pytest.raises(Exception):
        trips.scan(spark, str(tmp_path), ["yellow"], months).count()


def test_last_wins_settles_repeated_keys(spark):
    from odflow.sources.upserts import last_wins

    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    incoming = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, last_wins(stored, incoming, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_the_last_write_of_a_batch_counts(spark, tmp_path):
    path = str(tmp_path / "demand")
    schema = "route_id int, hour timestamp_ntz, volume int, written date, place int"
    hour, days = T(2024, 1, 1), [dt.date(2024, 2, d) for d in (1, 2)]
    keys, order = ["route_id", "hour"], ["written", "place"]

    def write(data):
        upserts.upsert(spark, path, spark.createDataFrame(data, schema), keys, F.col("hour"), order)
        return {(r["route_id"]): r["volume"] for r in spark.read.parquet(path).collect()}

    first = [(1, hour, 90, days[0], 5), (1, hour, 10, days[1], 1), (1, hour, 20, days[1], 0), (2, hour, 7, None, 1), (2, hour, 3, days[0], 1)]
    assert write(first) == {1: 10, 2: 3}
    assert set(spark.read.parquet(path).columns) == {"route_id", "hour", "volume", "day"}
    again = [(1, hour, 4, days[0], 0), (1, hour, 5, days[0], 0), (3, hour, None, days[0], 0)]
    assert write(again) == {1: 5, 2: 3, 3: None} and write(again) == {1: 5, 2: 3, 3: None}
