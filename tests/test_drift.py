from __future__ import annotations

import datetime as dt
import json

from odflow.plans.ingest import ingest_events
from odflow.sources import drift
from odflow.streaming.delays import trip_updates


def test_events_of_any_shape_become_rows_or_rejects(spark):
    day = dt.date(2024, 5, 4)
    payloads = {
        '[{"event_start_date": "2024-05-04T10:00:00.000", "new": {"a": [1]}}, {"k": 1}]': [(day, None), (None, drift.NO_DATE)],
        '[{"event_start_date": 20240504}, {"event_start_date": null}]': [(None, drift.WRONG_TYPE), (None, drift.NO_DATE)],
        '[{"event_start_date": {"y": 2024}}, {"event_start_date": "20240504"}]': [(None, drift.WRONG_TYPE), (day, None)],
        '[{"event_start_date": "2024-02-30"}, 7, "x", [1]]': [(None, drift.NO_SUCH_DAY)] + [(None, drift.NO_DATE)] * 3,
        '{"event_start_date": "2024-05-04"}': [(None, drift.NOT_A_LIST)],
        "[]": [],
        "{half": [(None, drift.NOT_JSON)],
        "": [(None, drift.NOT_JSON)],
        None: [(None, drift.NOT_JSON)],
    }
    df = spark.createDataFrame([(p,) for p in payloads], "body string")
    got = {p: [] for p in payloads}
    rows = drift.read_events(df, "body")
    for r in rows.collect():
        got[r["payload"]].append((r["event_date"], r["reason"]))
    assert {p: sorted(v, key=str) for p, v in got.items()} == {p: sorted(v, key=str) for p, v in payloads.items()}
    good, rejects = drift.split_rejects(rows)
    assert good.columns == ["event_date"] and good.count() == 2 and rejects.count() == sum(r is not None for v in payloads.values() for _, r in v)


def message(updates, **more):
    return json.dumps({"entity": [{"id": "1", "trip_update": {"trip": {"trip_id": "T"}, "stop_time_update": updates}, **more}], "header": {}})


FEED = [
    message([{"stop_id": "A", "arrival": {"delay": 3}}, {"stop_id": "B", "arrival": {}}, {"stop_id": "C"}]),
    message([{"stop_id": 5, "arrival": {"delay": "4.5", "uncertainty": 1}}], vehicle={"x": 1}),
    message([{"stop_id": "D", "arrival": {"delay": "late"}}, {"stop_id": "E", "arrival": [1]}]),
    json.dumps({"entity": [{"vehicle": {"id": 1}}, 3]}),
    json.dumps({"entity": "none"}),
    json.dumps([1, 2]),
    "broken",
]
GOOD = {("T", "A", 3.0), ("T", "5", 4.5)}
REASONS = [drift.NO_DELAY] * 4 + [drift.NO_ENTITIES] * 2 + [drift.NOT_JSON]


def test_feeds_of_any_shape_in_a_batch(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(FEED)], "n int, body string")
    good, rejects = drift.split_rejects(drift.read_trip_updates(df, "body", "n"))
    assert {(r["trip_id"], r["stop_id"], r["delay"]) for r in good.collect()} == GOOD
    assert sorted(r["reason"] for r in rejects.collect()) == sorted(REASONS)
    assert {r["payload"] for r in rejects.collect()} == {FEED[i] for i in (0, 2, 4, 5, 6)}
    plain = df.filter("n = 0")
    assert trip_updates(plain, "body").collect() == drift.split_rejects(drift.read_trip_updates(plain, "body"))[0].collect()


def test_feeds_of_any_shape_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(FEED))
    stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    rows = drift.read_trip_updates(stream, "value")
    out = str(tmp_path / "out")
    query = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start(out, format="parquet")
    query.awaitTermination()
    good, rejects = drift.split_rejects(spark.read.parquet(out))
    assert {(r["trip_id"], r["stop_id"], r["delay"]) for r in good.collect()} == GOOD
    assert sorted(r["reason"] for r in rejects.collect()) == sorted(REASONS)


def test_event_files_with_a_rejects_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a": '[{"event_start_date": "2024-05-04"},\n {"k": 1}]', "b": '[{"event_start_date": "20240504"}]', "c": "<html>"}.items():
        (tmp_path / "in" / f"{name}.json").write_text(text)
    got = ingest_events(spark, str(tmp_path / "in"), str(tmp_path))
    assert [r["event_date"] for r in got.collect()] == [dt.date(2024, 5, 4)]
    rejects = spark.read.parquet(str(tmp_path / "event_rejects"))
    assert sorted(r["reason"] for r in rejects.collect()) == [drift.NO_DATE, drift.NOT_JSON]
