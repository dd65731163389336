"""Zones covered by a quadtree of cells: coarse inside, fine where a border runs.

A cell is ``(level, cx, cy)``; its side is ``size * 2 ** level``, so a cell of level 1 holds four of level 0.
A zone's box is cut into cells of the coarsest level. A cell that no edge comes near is dropped outside the zone and
kept as ``whole`` inside; one with few edges is kept with them; any other is cut into four, down to level 0.
A point lies in one cell of each level and meets the zones there by an equi-join. Cells grow with the border of a
zone, not with its area, and one table serves containment and distance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.operators.spatial import CELL_LIMIT, NEAREST_LIMIT, _cell, _distance, inside, on_boundary
from odflow.session import materialise, small_side

# A border cell with so many edges is not cut further: the test in the row is as cheap.
FEW_EDGES = 4


@dataclass(frozen=True)
class Cover:
    """``cells``: (zone_id, level, cx, cy, edges, near, whole); ``size``: side at level 0; ``levels``: those that occur."""

    cells: DataFrame
    size: float
    levels: list[int]

    def side(self, level: int) -> float:
        return self.size * 2**level


def _sifted(cells: DataFrame, edges: DataFrame, side: float) -> DataFrame:
    """Cells with the edges level with them (and not left of them) and those that touch them."""
    x_low, x_high = F.least("x1", "x2"), F.greatest("x1", "x2")
    y_low, y_high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rim = side * 1e-6  # cell borders are rounded, so keep a little more
    left, bottom = F.col("cx") * side - rim, F.col("cy") * side - rim
    right, top = (F.col("cx") + 1) * side + rim, (F.col("cy") + 1) * side + rim
    ahead = (y_low <= top) & (y_high >= bottom) & (x_high >= left)
    # an edge meets the rows of cells level with it only
    rows = F.sequence(_cell(y_low - rim, side) - 1, _cell(y_high + rim, side))
    edge = F.struct("x1", "y1", "x2", "y2")
    found = (
        cells.join(edges.withColumn("cy", F.explode(rows)), ["zone_id", "cy"])
        .filter(ahead)
        .groupBy("zone_id", "cx", "cy")
        .agg(
            F.collect_list(edge).alias("edges"),
            F.collect_list(F.when((x_low <= right) & _passes(left, bottom, right, top), edge)).alias("near"),
        )
    )
    middle = [(F.col(c) + 0.5) * side for c in ("cx", "cy")]
    cut = F.size("near") > 0
    return found.withColumn("whole", ~cut & inside(F.col("edges"), *middle)).filter(cut | F.col("whole"))


def _passes(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Whether the line of an edge meets the box; with the boxes overlapping, whether the edge does."""
    corners = [(x, y) for x in (left, right) for y in (bottom, top)]
    sides = [(F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1")) for x, y in corners]
    return (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def cover(edges: DataFrame, size: float, depth: int = 6, few: int = FEW_EDGES) -> Cover:
    """The covering of all zones with cells of side ``size`` to ``size * 2 ** depth``.

    ``edges`` has one row ``(zone_id, x1, y1, x2, y2)`` per polygon edge, holes and parts alike. One small
    job per level, each over the cells that the level above has cut.
    """
    side = size * 2**depth
    boxes = edges.groupBy("zone_id").agg(
        *[F.min(F.least(f"{c}1", f"{c}2")).alias(f"{c}_low") for c in "xy"],
        *[F.max(F.greatest(f"{c}1", f"{c}2")).alias(f"{c}_high") for c in "xy"],
    )

    def along(c: str) -> Column:
        return F.explode(F.sequence(_cell(F.col(f"{c}_low"), side), _cell(F.col(f"{c}_high"), side))).alias(f"c{c}")

    cells = boxes.select("zone_id", along("x"), "y_low", "y_high").select("zone_id", "cx", along("y"))
    kept, levels = [], []
    for level in range(depth, -1, -1):
        sifted = materialise(_sifted(cells, edges, size * 2**level), "cells")
        split = F.lit(level > 0) & (F.size("near") > few)
        own = sifted.filter(~split).withColumn("level", F.lit(level))
        counts = sifted.agg(F.count_if(~split), F.count_if(split)).first()
        if counts[0]:
            kept.append(own)
            levels.append(level)
        if not counts[1]:
            break
        quarters = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
        cells = sifted.filter(split).withColumn("q", F.explode(quarters)).select(
            "zone_id", (F.col("cx") * 2 + F.col("q.a")).alias("cx"), (F.col("cy") * 2 + F.col("q.b")).alias("cy")
        )
    if not kept:
        kept = [own]
    table = reduce(DataFrame.unionByName, kept)
    shown = F.when(F.col("whole"), F.slice("edges", 1, 0)).otherwise(F.col("edges"))
    table = table.withColumn("edges", shown).select("zone_id", "level", "cx", "cy", "edges", "near", "whole")
    return Cover(small_side(table, "1 + size(edges) + size(near)", limit=CELL_LIMIT), size, levels)


def _reach(tree: Cover, x: Column, y: Column, reach: float) -> Column:
    """The cells of every level that a box of ``reach`` around the point overlaps; that of the point for 0."""
    def box(level: int) -> Column:
        side = tree.side(level)
        xs = F.sequence(_cell(x - reach, side), _cell(x + reach, side))
        ys = F.sequence(_cell(y - reach, side), _cell(y + reach, side))
        cell = lambda cx, cy: F.struct(F.lit(level).alias("level"), cx.alias("cx"), cy.alias("cy"))
        return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: cell(cx, cy))))

    boxes = [box(level) for level in tree.levels]
    return F.concat(*boxes) if boxes else F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>")


def _met(points: DataFrame, tree: Cover, x: str, y: str, reach: float = 0.0) -> DataFrame:
    """Points with each cell of a zone in reach; a point or coordinate that is null meets none."""
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = known.withColumn("_c", F.explode(_reach(tree, F.col(x), F.col(y), reach)))
    spread = spread.withColumns({c: F.col(f"_c.{c}") for c in ("level", "cx", "cy")}).drop("_c")
    return spread.join(tree.cells, ["level", "cx", "cy"]).drop("level", "cx", "cy")


def zones_of_points(
    points: DataFrame, tree: Cover, x: str = "longitude", y: str = "latitude", boundary: bool = True
) -> DataFrame:
    """Points with each zone that contains them; points in no zone are dropped.

    ``boundary`` counts points on an edge as contained (intersects) or not (within).
    """
    px, py = F.col(x), F.col(y)
    on_edge, within = on_boundary(F.col("near"), px, py), inside(F.col("edges"), px, py)
    test = F.col("whole") | ((within | on_edge) if boundary else (within & ~on_edge))
    return _met(points, tree, x, y).filter(test).drop("edges", "near", "whole")


def nearest_zones(
    points: DataFrame, tree: Cover, key: str, x: str, y: str, limit: float = NEAREST_LIMIT
) -> DataFrame:
    """Zone with the nearest border at most ``limit`` away per point, ties to the smaller id.

    The point looks into the border cells around it, so zones need no cells beyond their border. With sides
    of ``limit`` or more it looks into at most nine cells a level. Distances are rounded to 12 digits.
    """
    border = F.array_min(F.transform("near", lambda e: _distance(e, F.col(x), F.col(y))))
    near = _met(points.select(key, x, y), tree, x, y, limit).filter(~F.col("whole"))
    return (
        near.select(key, "zone_id", F.round(border, 12).alias("distance"))
        .filter(F.col("distance") <= limit)
        .groupBy(key)
        .agg(F.min_by("zone_id", F.struct("distance", "zone_id")).alias("zone_id"))
    )


def map_stops(stops: DataFrame, tree: Cover, limit: float = NEAREST_LIMIT) -> DataFrame:
    """``stop_id`` to zone: the smallest zone around the stop, else the nearest within ``limit``; others are dropped."""
    located = stops.dropna(subset=["stop_id", "stop_lat", "stop_lon"])
    around = zones_of_points(located, tree, "stop_lon", "stop_lat", boundary=False).groupBy("stop_id").agg(
        F.min("zone_id").alias("zone_id")
    )
    around = materialise(around, "around")
    rest = located.join(around, "stop_id", "left_anti")
    close = nearest_zones(rest, tree, "stop_id", "stop_lon", "stop_lat", limit)
    return around.unionByName(close).withColumn("zone_id", F.col("zone_id").cast("int"))
