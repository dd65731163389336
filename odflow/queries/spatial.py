"""Points in polygons and stops to zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.operators import congestion as signals
from odflow.operators import covering, spatial
from odflow.plans import ingest
from odflow.queries.base import query, with_tables
from odflow.session import scratch_path
from odflow.sources import driver_tables as src
from odflow.sources.tables import read_table

# Exact test of every point against every polygon: crossing number plus edges.
ON_EDGE = """(x2 - x1) * (py - y1) = (y2 - y1) * (px - x1)
    AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2)"""
CROSSES = """(y1 > py) <> (y2 > py) AND px < x1 + (py - y1) / (y2 - y1) * (x2 - x1)"""


def containment(points: str, key: str, x: str, y: str, test: str) -> str:
    return f"""
        SELECT {key}, zone_id FROM (
            SELECT {key}, zone_id, count_if({CROSSES}) % 2 = 1 AS inside, count_if({ON_EDGE}) > 0 AS edge
            FROM (SELECT {key}, {x} AS px, {y} AS py FROM {points}), edges GROUP BY {key}, zone_id)
        WHERE {test}"""


PLACED = {"placed": containment("positions", "event_id", "longitude", "latitude", "inside OR edge")}
WITHIN = {"inner_zone": containment("stops", "stop_id", "stop_lon", "stop_lat", "inside AND NOT edge")}


@query(
    "points_in_zones",
    with_tables("edges positions", "SELECT event_id, zone_id FROM placed", PLACED),
)
def points_in_zones(spark, folder):
    """Positions with every zone that contains or touches them."""
    found = spatial.zones_of_points(
        src.positions(spark, folder), src.zone_edges(spark, folder), size=0.05
    )
    return found.select("event_id", "zone_id")


VARIANCES = with_tables(
    "edges positions",
    """SELECT zone_id, date_trunc('hour', ts) AS hour,
              round(coalesce(var_samp(value), 0.0), 8) AS travel_time_var, count(value) AS sample_count
       FROM placed JOIN positions USING (event_id) GROUP BY 1, 2""",
    PLACED,
)


@query("position_backfill", VARIANCES, digits=8)
def position_backfill(spark, folder):
    """The stored table after every second day was loaded and the missing days were filled in."""
    samples = signals.position_samples(src.positions(spark, folder))
    edges, warehouse = src.zone_edges(spark, folder), scratch_path(spark, "warehouse")
    ingest.ingest_positions(spark, samples.filter(F.dayofmonth("hour") % 2 == 0), edges, warehouse, size=0.05)
    day = F.col("hour").cast("date")
    span = samples.agg(F.min(day).alias("start"), F.max(day).alias("end"))
    ingest.backfill_positions(spark, samples, edges, span, warehouse, size=0.05)
    return read_table(spark, warehouse, "congestion")


@query("position_variance", VARIANCES, digits=8)
def position_variance(spark, folder):
    """Vehicle positions to travel-time variance per zone and hour."""
    samples = signals.position_samples(src.positions(spark, folder))
    return signals.zone_variance(
        spatial.zones_of_points(samples, src.zone_edges(spark, folder), size=0.05)
    )


NEAR = """
    SELECT stop_id, zone_id, min(sqrt((px - (x1 + t * (x2 - x1))) ** 2 + (py - (y1 + t * (y2 - y1))) ** 2)) AS d
    FROM (SELECT *, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1))
                                         / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t
          FROM (SELECT stop_id, stop_lon AS px, stop_lat AS py FROM stops
                WHERE stop_id NOT IN (SELECT stop_id FROM inner_zone)), edges)
    GROUP BY 1, 2"""


@query(
    "stop_zone_map",
    with_tables(
        "edges stops",
        """SELECT stop_id, CAST(min(zone_id) AS INTEGER) AS zone_id FROM inner_zone GROUP BY 1
           UNION ALL
           SELECT stop_id, CAST(arg_min(zone_id, (round(d, 12), zone_id)) AS INTEGER) FROM near
           WHERE round(d, 12) <= 0.125 GROUP BY 1""",
        {**WITHIN, "near": NEAR},
    ),
)
def stop_zone_map(spark, folder):
    """The zone around each stop, else the nearest at most 0.125 away."""
    return spatial.map_stops(
        src.stops(spark, folder), src.zone_edges(spark, folder), limit=0.125, size=0.25
    )


@query(
    "first_zone_per_point",
    with_tables(
        "edges positions", "SELECT event_id, CAST(min(zone_id) AS INTEGER) AS zone_id FROM placed GROUP BY 1", PLACED
    ),
)
def first_zone_per_point(spark, folder):
    """One zone per position: the smallest of those that hold it."""
    return points_in_zones(spark, folder).groupBy("event_id").agg({"zone_id": "min"}).withColumnRenamed(
        "min(zone_id)", "zone_id"
    )

@query("points_in_covered_zones", with_tables("edges positions", "SELECT event_id, zone_id FROM placed", PLACED))
def points_in_covered_zones(spark, folder):
    """Positions with every zone that contains or touches them, through the quadtree of the zones."""
    tree = covering.cover(src.zone_edges(spark, folder), 0.01, depth=6)
    return covering.zones_of_points(src.positions(spark, folder), tree).select("event_id", "zone_id")


STOP_ZONES = with_tables(
    "edges stops",
    """SELECT stop_id, CAST(min(zone_id) AS INTEGER) AS zone_id FROM inner_zone GROUP BY 1
       UNION ALL
       SELECT stop_id, CAST(arg_min(zone_id, (round(d, 12), zone_id)) AS INTEGER) FROM near
       WHERE round(d, 12) <= 0.125 GROUP BY 1""",
    {**WITHIN, "near": NEAR},
)


@query("stop_zone_cover", STOP_ZONES)
def stop_zone_cover(spark, folder):
    """The zone around each stop, else the nearest at most 0.125 away, through the quadtree of the zones."""
    tree = covering.cover(src.zone_edges(spark, folder), 0.0625, depth=4)
    return covering.map_stops(src.stops(spark, folder), tree, limit=0.125)
