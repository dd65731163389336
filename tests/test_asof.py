from __future__ import annotations

import datetime as dt
import random

from odflow.operators.asof import congestion_at, last_known

START = dt.datetime(2024, 1, 1)
ASKED = "id int, zone_id int, as_of timestamp_ntz, a string"
SEEN = "zone_id int, t timestamp_ntz, a double, b int"


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


def brute(asked, seen, hours):
    out = {}
    for i, zone, t, _ in asked:
        picked = []
        for k in (2, 3):
            known = [r for r in seen if zone is not None and t is not None and r[0] == zone and r[1] is not None and r[1] <= t and r[k] is not None]
            last = max(known, key=lambda r: (r[1], r[k]), default=None)
            picked.append(last[k] if last and (hours is None or t - last[1] <= dt.timedelta(hours=hours)) else None)
        out[i] = tuple(picked)
    return out


def test_matches_brute_force(spark):
    draw = random.Random(9)
    zones = [1] * 8 + [2, 3, None]  # one busy zone
    seen = [
        (draw.choice(zones), at(draw.choice([None, *range(0, 9000, 15)])), draw.choice([None, 1.5, 2.5, float(k)]), draw.choice([None, k]))
        for k in range(1500)
    ]
    asked = [(k, draw.choice([*zones, 4]), at(draw.choice([None, *range(0, 12_000, 5)])), "x") for k in range(700)]
    requests, observations = spark.createDataFrame(asked, ASKED), spark.createDataFrame(seen, SEEN)
    for age, hours in ((None, None), ("3 HOURS", 3), ("40 HOURS", 40)):
        for bucket in ("hour", "day", "month"):
            got = last_known(requests, observations, ["zone_id"], "as_of", "t", ["a", "b"], age, bucket)
            assert got.columns == ["id", "zone_id", "as_of", "a", "b"]
            assert {r["id"]: (r["a"], r["b"]) for r in got.collect()} == brute(asked, seen, hours)


def test_repeated_requests_stay_and_plan_has_no_range_join(spark):
    requests = spark.createDataFrame([(1, 1, at(60), "x")] * 3, ASKED)
    observations = spark.createDataFrame([(1, at(60), 4.0, None), (1, at(0), 3.0, 7)], SEEN)
    got = last_known(requests, observations, ["zone_id"], "as_of", "t", ["a", "b"])
    assert [(r["a"], r["b"]) for r in got.collect()] == [(4.0, 7)] * 3
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert last_known(requests.limit(0), observations, ["zone_id"], "as_of", "t", ["a"]).count() == 0
    none = last_known(requests, observations.limit(0), ["zone_id"], "as_of", "t", ["a"])
    assert [r["a"] for r in none.collect()] == [None] * 3


def test_an_hour_is_known_when_it_is_over(spark):
    congestion = spark.createDataFrame([(1, at(0), 5.0, 9), (1, at(60), 6.0, 4)], "zone_id int, hour timestamp_ntz, travel_time_var double, sample_count long")
    requests = spark.createDataFrame([(1, 1, at(59), ""), (2, 1, at(60), ""), (3, 1, at(121), ""), (4, 2, at(121), "")], ASKED)
    got = {r["id"]: (r["travel_time_var"], r["sample_count"]) for r in congestion_at(requests, congestion).collect()}
    assert got == {1: (0.0, 0), 2: (5.0, 9), 3: (6.0, 4), 4: (0.0, 0)}
    old = congestion_at(requests, congestion, max_age="1 MINUTE")
    assert {r["id"]: r["sample_count"] for r in old.collect()} == {1: 0, 2: 9, 3: 4, 4: 0}
