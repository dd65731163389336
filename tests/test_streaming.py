from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from odflow.functions.scalars import hour_of
from odflow.operators.congestion import zone_delays
from odflow.plans.ingest import ingest_feeds
from odflow.sources import tables
from odflow.streaming import delays as live

SCHEMA = "stop_id string, delay double, feed_id string, polled_at timestamp_ntz"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Three files; the last one brings rows of the first hours again."""
    source = f"{tmp_path}/feed"
    parts = [
        [(str(i % 5), float(i), "a", at(i * 7)) for i in range(40)],
        [(str(i % 5), float(i), "b", at(i * 11)) for i in range(40)],
        [(str(i % 5), float(i) / 2, "a", at(i)) for i in range(30)],
    ]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stops = spark.createDataFrame([(str(i), i % 2) for i in range(4)], tables.STOP_MAP)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    batch = zone_delays(spark.read.parquet(source), stops, hour_of(F.col("polled_at")))
    return source, stream, stops, batch


def rows(df):
    return sorted(
        (r["zone_id"], r["hour"], r["feed_id"], round(r["mean_delay"], 9), r["trip_count"]) for r in df.collect()
    )


def test_log_equals_batch_and_survives_replay(spark, feed, tmp_path):
    source, stream, stops, batch = feed
    path, progress = f"{tmp_path}/log", f"{tmp_path}/progress"
    live.start_delay_log(stream, stops, path, progress).awaitTermination()
    assert spark.read.parquet(path).select("batch_id").distinct().count() == 3
    assert rows(live.read_delays(spark, path)) == rows(batch)

    live.start_delay_log(stream, stops, path, progress).awaitTermination()  # nothing new
    assert rows(live.read_delays(spark, path)) == rows(batch)
    # A lost progress folder replays every batch over itself.
    live.start_delay_log(stream, stops, path, f"{tmp_path}/again").awaitTermination()
    assert rows(live.read_delays(spark, path)) == rows(batch)

    more = [("1", 5.0, "a", at(3))]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    live.start_delay_log(stream, stops, path, f"{tmp_path}/again").awaitTermination()
    whole = zone_delays(spark.read.parquet(source), stops, hour_of(F.col("polled_at")))
    assert rows(live.read_delays(spark, path)) == rows(whole) != rows(batch)
    for _ in range(2):
        live.fold_log(spark, path, f"{tmp_path}/base", 1)
    assert rows(live.read_delays(spark, path, f"{tmp_path}/base", 1)) == rows(whole)


def test_windows_equal_batch(spark, feed, tmp_path):
    _, stream, stops, batch = feed
    path = f"{tmp_path}/windows"
    live.start_windowed(stream, stops, path, f"{tmp_path}/progress", "7 days").awaitTermination()
    assert rows(live.read_windowed(spark, path)) == rows(batch)
    for _ in range(2):
        live.fold_windowed(spark, path, f"{tmp_path}/base", 1)
    assert rows(live.read_windowed(spark, path, f"{tmp_path}/base", 1)) == rows(batch)


def test_late_rows_and_unmapped_stops(spark, tmp_path):
    source = f"{tmp_path}/feed"
    for day in (10, 0, 10):  # the second file is ten days late
        spark.createDataFrame([(s, 5.0, "a", at(day * 1440)) for s in ("1", "9")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stops = spark.createDataFrame([("1", 4), ("9", None)], tables.STOP_MAP)

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

    live.start_delay_log(stream(), stops, f"{tmp_path}/log", f"{tmp_path}/p1").awaitTermination()
    assert rows(live.read_delays(spark, f"{tmp_path}/log")) == [(4, at(0), "a", 5.0, 1), (4, at(14400), "a", 5.0, 2)]
    run = live.start_windowed(stream(), stops, f"{tmp_path}/windows", f"{tmp_path}/p2", "1 day")
    run.awaitTermination()
    kept = rows(live.read_windowed(spark, f"{tmp_path}/windows"))
    assert sum(r[4] for r in kept) + live.dropped_rows(run) == 3 and all(r[0] == 4 for r in kept)


def test_landed_feed_files(spark, tmp_path):
    folder, warehouse = f"{tmp_path}/landed", f"{tmp_path}/warehouse"
    stops = spark.createDataFrame([("101N", 7)], tables.STOP_MAP)

    def land(feed, name, text):
        (tmp_path / "landed" / f"feed_id={feed}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "landed" / f"feed_id={feed}" / name).write_text(text)

    def update(delay):
        return json.dumps({"entity": [{"trip_update": {"stop_time_update": [{"stop_id": "101N", "arrival": {"delay": delay}}]}}]}, indent=1)

    land("ace", "1.json", update(60))
    land("l", "1.json", update(30))
    land("l", "2.json", "not json")
    first = ingest_feeds(spark, folder, stops, warehouse).groupBy("feed_id").agg(F.sum("trip_count")).collect()
    assert sorted(map(tuple, first)) == [("ace", 1), ("l", 1)]
    land("l", "3.json", update(90))
    again = ingest_feeds(spark, folder, stops, warehouse)
    got = again.groupBy("zone_id", "feed_id").agg(F.sum("trip_count"), F.sum(F.col("mean_delay") * F.col("trip_count"))).collect()
    assert sorted(map(tuple, got)) == [(7, "ace", 1, 60.0), (7, "l", 2, 120.0)]


def test_add_poll(spark):
    stored = spark.createDataFrame([(1, at(0), "a", 60.0, 1)], tables.DELAYS)
    polled = spark.createDataFrame([(1, at(0), "a", 90.0, 2), (1, at(0), "b", 1.0, 1)], tables.DELAYS)
    assert rows(live.add_poll(stored, polled)) == [(1, at(0), "a", 80.0, 3), (1, at(0), "b", 1.0, 1)]


def test_only_updates_with_an_arrival_delay(spark):
    message = {
        "entity": [
            {"trip_update": {"stop_time_update": [
                {"stop_id": "101N", "arrival": {"delay": 60}}, {"stop_id": "102S", "arrival": {}},
                {"stop_id": "103N", "departure": {"delay": 5}}, {"stop_id": "104N", "arrival": {"delay": 0}}]}},
            {"vehicle": {"id": "7"}},
        ]
    }
    df = spark.createDataFrame([(json.dumps(message),), ("not json",), ('{"entity": []}',)], "payload string")
    assert [tuple(r) for r in live.stop_updates(df, "payload").collect()] == [("101N", 60.0), ("104N", 0.0)]


POLLS = "feed_id string, trip_id string, stop_id string, delay double, polled_at timestamp_ntz"


def test_replayed_and_overlapping_polls_give_the_batch_result(spark, tmp_path):
    """Polls every ten minutes, each with the trips of the one before; one is replayed, and one comes after a restart."""
    source, log, progress = (f"{tmp_path}/{n}" for n in ("polls", "log", "progress"))
    stops = spark.createDataFrame([(str(i), i % 2) for i in range(4)], tables.STOP_MAP)
    polls = [
        [("a", f"t{t}", str(t % 4), float(10 * t + k), at(10 * k)) for t in range(k, k + 6)] + [("a", None, "1", 5.0, at(10 * k))]
        for k in range(13)
    ]

    def land(rows, name):
        spark.createDataFrame(rows, POLLS).coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        raw = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        live.start_delay_log(live.unique_polls(raw, "3 hours"), stops, log, progress).awaitTermination()

    for k, rows in enumerate(polls[:6]):
        land(rows, f"p{k:02d}")
    run()
    land(polls[2], "p06-replayed")
    for k, rows in enumerate(polls[6:], start=7):
        land(rows, f"p{k:02d}")
    run()
    every = spark.createDataFrame([r for rows in polls for r in rows], POLLS)
    want = zone_delays(live.first_polls(every.union(every)), stops, F.date_trunc("hour", "polled_at"))
    keys = lambda df: sorted((r["zone_id"], str(r["hour"]), r["feed_id"], r["trip_count"], round(r["mean_delay"], 6)) for r in df.collect())
    assert keys(live.read_delays(spark, log)) == keys(want)
    raw_count = zone_delays(every, stops, F.date_trunc("hour", "polled_at")).agg(F.sum("trip_count")).first()[0]
    assert live.read_delays(spark, log).agg(F.sum("trip_count")).first()[0] < raw_count


def test_trips_are_read_from_the_feed(spark):
    update = {"trip_update": {"trip": {"trip_id": "x1"}, "stop_time_update": [{"stop_id": "101N", "arrival": {"delay": 60}}]}}
    df = spark.createDataFrame([(json.dumps({"entity": [update]}),)], "payload string")
    assert [tuple(r) for r in live.trip_updates(df, "payload").collect()] == [("x1", "101N", 60.0)]
