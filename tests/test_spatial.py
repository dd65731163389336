from __future__ import annotations

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from odflow.operators import covering, spatial

EDGES = "zone_id int, x1 double, y1 double, x2 double, y2 double"
POINTS = "id int, longitude double, latitude double"


def edges_of(zone, ring):
    return [(zone, *map(float, a), *map(float, b)) for a, b in zip(ring, ring[1:] + ring[:1])]


def disc(zone, x, y, radius=0.01, n=32):
    return edges_of(zone, [(x + radius * math.cos(t), y + radius * math.sin(t)) for t in np.linspace(0, 2 * math.pi, n, endpoint=False)])


def brute(edges, x, y):
    inside = False
    for _, x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            inside = not inside
    return inside


def gap(edges, x, y):
    best = math.inf
    for _, x1, y1, x2, y2 in edges:
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


@pytest.mark.parametrize("size", [0.003, 0.02, 5.0])
def test_random_points_match_brute_force(spark, size):
    rng = np.random.default_rng(4)
    zones = {
        1: disc(1, -73.99, 40.75), 2: disc(2, -73.97, 40.76),
        # a star-shaped zone with a hole, overlapping the first disc
        3: edges_of(3, [(-73.99 + (0.012 if k % 2 else 0.004) * math.cos(k * math.pi / 6),
                         40.755 + (0.012 if k % 2 else 0.004) * math.sin(k * math.pi / 6)) for k in range(12)])
        + disc(3, -73.99, 40.755, 0.002, 8),
    }
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform((-74.01, 40.73), (-73.95, 40.78), (1500, 2)))]
    got = spatial.zones_of_points(
        spark.createDataFrame(points, POINTS),
        spark.createDataFrame([e for es in zones.values() for e in es], EDGES),
        size=size,
    )
    want = {(i, z) for i, x, y in points for z, es in zones.items() if brute(es, x, y)}
    assert {(r["id"], r["zone_id"]) for r in got.collect()} == want and len(want) > 100


def square(zone, x, y):
    return edges_of(zone, [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])


def test_boundaries(spark):
    edges = spark.createDataFrame(square(1, 0, 0) + square(2, 1, 0), EDGES)
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 0.0, 0.0), (3, 2.0, 1.0), (4, 0.5, 0.5), (5, 2.5, 0.5)], POINTS)
    touching = {(r["id"], r["zone_id"]) for r in spatial.zones_of_points(points, edges, size=0.1).collect()}
    assert touching == {(1, 1), (1, 2), (2, 1), (3, 2), (4, 1)}
    within = {(r["id"], r["zone_id"]) for r in spatial.zones_of_points(points, edges, size=0.1, boundary=False).collect()}
    assert within == {(4, 1)}


def test_stops_fall_back_to_the_nearest_zone(spark):
    rng = np.random.default_rng(6)
    zones = {1: disc(1, 0.0, 0.0), 2: disc(2, 0.03, 0.0)}
    stops = [(f"s{i}", float(y), float(x)) for i, (x, y) in enumerate(rng.uniform((-0.03, -0.03), (0.06, 0.03), (600, 2)))]
    stops += [("null", None, 0.0)]
    got = spatial.map_stops(
        spark.createDataFrame(stops, "stop_id string, stop_lat double, stop_lon double"),
        spark.createDataFrame(zones[1] + zones[2], EDGES),
    )
    want = {}
    for stop, y, x in stops[:-1]:
        inside = [z for z in zones if brute(zones[z], x, y)]
        near = sorted((gap(es, x, y), z) for z, es in zones.items())
        if inside:
            want[stop] = inside[0]
        elif near[0][0] <= 0.01:
            want[stop] = near[0][1]
    assert {r["stop_id"]: r["zone_id"] for r in got.collect()} == want and 0 < len(want) < 600


def test_detailed_zone(spark):
    """A ring of 10,000 edges: each edge meets only the cells of its own rows."""
    ring = disc(1, 0.0, 0.0, 0.1, 10_000)
    edges = spark.createDataFrame(ring, EDGES)
    rng = np.random.default_rng(8)
    stops = [(f"s{i}", float(y), float(x)) for i, (x, y) in enumerate(rng.uniform(-0.12, 0.12, (400, 2)))]
    got = spatial.map_stops(spark.createDataFrame(stops, "stop_id string, stop_lat double, stop_lon double"), edges)
    want = {s for s, y, x in stops if math.hypot(x, y) < 0.1 + 0.01 - 1e-6}
    assert {r["stop_id"] for r in got.collect()} == want and 0 < len(want) < 400
    cells = spatial.zone_cells(edges, 0.005).agg({"*": "count"}).first()[0]
    assert cells < 45 * 45


def wavy(zone, x, y, radius, n):
    """A large zone with a border of ``n`` edges."""
    ring = [
        (x + radius * (1 + 0.05 * math.sin(40 * t)) * math.cos(t), y + radius * (1 + 0.05 * math.sin(40 * t)) * math.sin(t))
        for t in np.linspace(0, 2 * math.pi, n, endpoint=False)
    ]
    return edges_of(zone, ring)


@pytest.fixture(scope="module")
def landscape(spark):
    """A large wavy zone with a hole, one inside it, one beside it, and points on and around them."""
    edges = wavy(1, 0.0, 0.0, 2.0, 600) + disc(1, 0.5, 0.5, 0.2, 16) + square(2, -0.5, -0.5) + disc(3, 4.0, 0.0, 0.01)
    rng = np.random.default_rng(12)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform((-2.6, -2.6), (4.3, 2.6), (3000, 2)))]
    points += [(9001, -0.5, 0.0), (9002, 0.5, 0.5), (9003, 4.0, 0.011), (9004, 0.0, 0.5)]
    df = spark.createDataFrame([*points, (9005, None, 1.0)], POINTS)
    return edges, points, spark.createDataFrame(edges, EDGES), df


@pytest.mark.parametrize(("size", "depth"), [(0.01, 6), (0.05, 0), (0.3, 3)])
def test_cover_gives_the_rows_of_the_grid(landscape, size, depth):
    _, _, edges, points = landscape
    tree = covering.cover(edges, size, depth)
    for boundary in (True, False):
        got = covering.zones_of_points(points, tree, boundary=boundary).select("id", "zone_id")
        want = spatial.zones_of_points(points, edges, size=0.05, boundary=boundary).select("id", "zone_id")
        assert sorted(got.collect()) == sorted(want.collect())


def test_cover_matches_brute_force_and_nearest_needs_no_padding(landscape):
    edges, points, edge_rows, df = landscape
    tree = covering.cover(edge_rows, 0.01, 6)
    by_zone = {z: [e for e in edges if e[0] == z] for z in (1, 2, 3)}
    got = {(r["id"], r["zone_id"]) for r in covering.zones_of_points(df, tree).collect()}
    sample = points[:3000:7]
    assert {g for g in got if g[0] % 7 == 0 and g[0] < 9000} == {(i, z) for i, x, y in sample for z, es in by_zone.items() if brute(es, x, y)}
    limit = 0.08
    near = {r["id"]: r["zone_id"] for r in covering.nearest_zones(df, tree, "id", "longitude", "latitude", limit).collect()}
    for i, x, y in sample:
        found = min((round(gap(es, x, y), 12), z) for z, es in by_zone.items())
        assert near.get(i) == (found[1] if found[0] <= limit else None)


def test_cover_of_a_large_zone_is_small(landscape):
    _, _, edges, _ = landscape
    grid = spatial.zone_cells(edges, 0.01)
    tree = covering.cover(edges, 0.01, 6)
    assert grid.count() > 5 * tree.cells.count() and len(tree.levels) > 3
    weight = F.sum(F.lit(1) + F.size("edges") + F.size("near"))
    assert grid.agg(weight).first()[0] > 5 * tree.cells.agg(weight).first()[0]


def test_cover_of_nothing(spark, landscape):
    _, _, edges, points = landscape
    tree = covering.cover(edges.limit(0), 0.01)
    assert covering.zones_of_points(points, tree).count() == 0
    assert covering.nearest_zones(points, tree, "id", "longitude", "latitude").count() == 0
    full = covering.cover(edges, 0.5, 2)
    assert covering.zones_of_points(points.limit(0), full).count() == 0
