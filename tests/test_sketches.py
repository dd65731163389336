from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from odflow.operators import sketches

LEVELS = [0.01, 0.1, 0.5, 0.9, 0.99]


@pytest.fixture(scope="module")
def raw(spark):
    rng, rows = np.random.default_rng(4), []
    for i, v in enumerate(rng.lognormal(2, 1, 60_000)):
        rows.append((int(i % 3 == 0), dt.datetime(2024, 1, 1 + i % 10, i % 24), float(v), int(rng.integers(0, 5000))))
    rows += [(0, dt.datetime(2024, 1, 3), None, None), (0, dt.datetime(2024, 1, 3), float("nan"), 1), (0, None, 1.0, 1)]
    rows += [(7, dt.datetime(2024, 1, 2), None, 3)]
    return rows, spark.createDataFrame(rows, "g int, ts timestamp_ntz, v double, who long")


@pytest.fixture(scope="module")
def stored(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches"))
    sketches.write_sketches(sketches.daily_sketches(raw[1], ["g"], "ts", "v", "who"), path)
    return path


def test_ranges_of_days_lie_within_the_errors(spark, raw, stored):
    for first, last in ((1, 10), (3, 6), (5, 5)):
        part = sketches.read_sketches(spark, stored, f"2024-01-{first:02d}", f"2024-01-{last:02d}")
        for r in sketches.estimates(part, ["g"], LEVELS).collect():
            own = [x for x in raw[0] if x[0] == r["g"] and x[1] and first <= x[1].day <= last]
            values = np.array([x[2] for x in own if x[2] is not None and not np.isnan(x[2])])
            assert r["n"] == len(values)
            if len(values) == 0:
                assert r["quantiles"] is None and r["distinct"] == 1
                continue
            assert (r["least"], r["most"]) == (values.min(), values.max())
            for level, q in zip(LEVELS, r["quantiles"]):
                assert abs((values <= q).mean() - level) < 2 * sketches.RANK_ERROR
            many = len({x[3] for x in own if x[3] is not None})
            assert abs(r["distinct"] / many - 1) < sketches.DISTINCT_ERROR


def test_days_written_again_are_replaced(spark, raw, stored):
    before = sketches.read_sketches(spark, stored, "2024-01-01", "2024-01-10").count()
    again = raw[1].filter("day(ts) = 4")
    sketches.write_sketches(sketches.daily_sketches(again, ["g"], "ts", "v", "who"), stored)
    part = sketches.read_sketches(spark, stored, "2024-01-01", "2024-01-10")
    assert part.count() == before and sketches.estimates(part, ["g"], [0.5]).agg({"n": "sum"}).first()[0] == 60_000


def test_bins_hold_all_rows(spark, raw, stored):
    part = sketches.read_sketches(spark, stored, "2024-01-01", "2024-01-10")
    edges = [1.0, 3.0, 7.5, 20.0, 60.0]
    got = [r["rows"] for r in sketches.bins(part, ["g"], edges).filter("g = 1").orderBy("high").collect()]
    got = got[1:] + got[:1]  # the open bin at the top has a null edge, which sorts first
    values = np.array([x[2] for x in raw[0] if x[0] == 1])
    exact = np.diff([0, *[(values <= e).sum() for e in edges], len(values)])
    assert sum(got) == len(values)
    assert max(abs(r - e) for r, e in zip(got, exact)) < 2 * sketches.RANK_ERROR * len(values)


def test_no_rows(spark, raw):
    none = sketches.daily_sketches(raw[1].limit(0), ["g"], "ts", "v", "who")
    assert sketches.estimates(none, ["g"], [0.5]).count() == 0 and sketches.bins(none, ["g"], [3.0]).count() == 0
