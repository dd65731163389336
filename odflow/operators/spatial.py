"""Points to polygons with grid cells, equi-joins and per-row geometry.

Each zone is cut into the grid cells of its bounding box, and every cell keeps
only the edges that can matter inside it. A point then meets the few zones of
its own cell, and the exact test runs inside the row: no cross join, no
explosion of points by edges, no shuffle by point. The cell table grows with
the polygons, never with the points; it is counted and broadcast if small, so
that crowded cells cost nothing, else adaptive execution splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.session import small_side

# Fixed value: farthest zone a stop may be assigned to, in degrees.
NEAREST_LIMIT = 0.01
# Largest cell table sent to every executor, in cells and edges (about 100 MB).
CELL_LIMIT = 2_000_000


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def zone_cells(edges: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """``(zone_id, cx, cy, edges, near, whole)`` for every cell within ``pad`` of a zone's box.

    ``edges`` has one row ``(zone_id, x1, y1, x2, y2)`` per polygon edge, holes
    and parts alike. A cell keeps two lists: ``edges``, those level with it and not
    left of it (a ray towards +x can only meet those), and ``near``, those within
    ``pad`` of it. A cell that no edge comes near is either dropped or ``whole``,
    and then needs no edges.
    """
    x_low, x_high = F.least("x1", "x2"), F.greatest("x1", "x2")
    y_low, y_high = F.least("y1", "y2"), F.greatest("y1", "y2")
    boxes = edges.groupBy("zone_id").agg(
        F.min(x_low).alias("bx1"),
        F.max(x_high).alias("bx2"),
        F.min(y_low).alias("by1"),
        F.max(y_high).alias("by2"),
    )
    cells = boxes.select(
        "zone_id",
        F.explode(F.sequence(_cell(F.col("bx1") - pad, size), _cell(F.col("bx2") + pad, size))).alias("cx"),
        "by1",
        "by2",
    ).select(
        "zone_id",
        "cx",
        F.explode(F.sequence(_cell(F.col("by1") - pad, size), _cell(F.col("by2") + pad, size))).alias("cy"),
    )

    def ahead(slack: float) -> Column:
        bottom, top = F.col("cy") * size - slack, (F.col("cy") + 1) * size + slack
        return (y_low <= top) & (y_high >= bottom) & (x_high >= F.col("cx") * size - slack)

    rim = size * 1e-6  # cell borders are rounded, so keep a little more
    slack = pad + rim
    level = ahead(rim)
    touching = ahead(slack) & (x_low <= (F.col("cx") + 1) * size + slack)
    # an edge meets the rows of cells level with it only, so a detailed zone is spread over its rows
    edge = F.struct("x1", "y1", "x2", "y2")
    rows = F.sequence(_cell(y_low - slack, size) - 1, _cell(y_high + slack, size))
    shaped = (
        cells.join(edges.withColumn("cy", F.explode(rows)), ["zone_id", "cy"])
        .filter(level | touching)
        .groupBy("zone_id", "cx", "cy")
        .agg(
            F.collect_list(F.when(level, edge)).alias("edges"),
            F.collect_list(F.when(touching, edge)).alias("near"),
            F.max(touching).alias("cut"),
        )
    )
    middle = [(F.col(c) + 0.5) * size for c in ("cx", "cy")]
    return (
        shaped.withColumn("whole", ~F.col("cut") & inside(F.col("edges"), *middle))
        .filter(F.col("cut") | F.col("whole"))
        .withColumn("edges", F.when(F.col("cut"), F.col("edges")).otherwise(F.slice("edges", 1, 0)))
        .drop("cut")
    )


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    cross = (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)
    return (
        (cross == 0)
        & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2))
        & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))
    )


def _crosses(e: Column, x: Column, y: Column) -> Column:
    at = e.x1 + (y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1)
    return ((e.y1 > y) != (e.y2 > y)) & (x < at)


def on_boundary(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(edges, lambda e: _on_edge(e, x, y))


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Odd number of edges crossed by a ray towards +x."""
    return F.size(F.filter(edges, lambda e: _crosses(e, x, y))) % 2 == 1


def _distance(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e.x2 - e.x1, e.y2 - e.y1
    length = dx * dx + dy * dy
    along = F.try_divide((x - e.x1) * dx + (y - e.y1) * dy, length)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return F.hypot(x - (e.x1 + t * dx), y - (e.y1 + t * dy))


def _at_cells(points: DataFrame, x: str, y: str, cells: DataFrame, size: float) -> DataFrame:
    placed = points.withColumns({"cx": _cell(F.col(x), size), "cy": _cell(F.col(y), size)})
    return placed.join(small_side(cells, "1 + size(edges) + size(near)", limit=CELL_LIMIT), ["cx", "cy"]).drop("cx", "cy")


def _gap(x: str, y: str) -> Column:
    """Distance to the nearest edge in reach, rounded to 12 digits: a tie is not decided by a last bit."""
    return F.round(F.array_min(F.transform("near", lambda e: _distance(e, F.col(x), F.col(y)))), 12)


def zones_of_points(
    points: DataFrame,
    edges: DataFrame,
    x: str = "longitude",
    y: str = "latitude",
    size: float = 0.005,
    boundary: bool = True,
) -> DataFrame:
    """Points with each zone that contains them; points in no zone are dropped.

    ``boundary`` counts points on an edge as contained (intersects) or not
    (within). A point on a shared edge then belongs to every zone that has it.
    """
    px, py = F.col(x), F.col(y)
    on_edge = on_boundary(F.col("near"), px, py)
    within = inside(F.col("edges"), px, py)
    test = F.col("whole") | ((within | on_edge) if boundary else (within & ~on_edge))
    return _at_cells(points, x, y, zone_cells(edges, size), size).filter(test).drop("edges", "near", "whole")


def nearest_zones(
    points: DataFrame,
    edges: DataFrame,
    key: str,
    x: str,
    y: str,
    limit: float = NEAREST_LIMIT,
    size: float = 0.005,
) -> DataFrame:
    """Zone with the nearest border at most ``limit`` away per point, ties to the smaller id."""
    near = _at_cells(points, x, y, zone_cells(edges, size, pad=limit), size)
    return (
        near.select(key, "zone_id", _gap(x, y).alias("distance"))
        .filter(F.col("distance") <= limit)
        .groupBy(key)
        .agg(F.min_by("zone_id", F.struct("distance", "zone_id")).alias("zone_id"))
    )


def map_stops(
    stops: DataFrame,
    edges: DataFrame,
    limit: float = NEAREST_LIMIT,
    size: float = 0.005,
) -> DataFrame:
    """``stop_id`` to zone: the zone around the stop, else the nearest within ``limit``.

    A stop in several zones takes the smallest id; stops without a zone are dropped.
    """
    located = stops.dropna(subset=["stop_id", "stop_lat", "stop_lon"])
    x, y = F.col("stop_lon"), F.col("stop_lat")
    within = F.col("whole") | (inside(F.col("edges"), x, y) & ~on_boundary(F.col("near"), x, y))
    reached = _at_cells(located, "stop_lon", "stop_lat", zone_cells(edges, size, pad=limit), size).select(
        "stop_id", "zone_id", within.alias("within"), _gap("stop_lon", "stop_lat").alias("distance")
    )
    around = F.min(F.when(F.col("within"), F.col("zone_id")))
    close = F.min(F.when(F.col("distance") <= limit, F.struct("distance", "zone_id"))).getField("zone_id")
    found = reached.groupBy("stop_id").agg(F.coalesce(around, close).cast("int").alias("zone_id"))
    return found.filter(F.col("zone_id").isNotNull())
