"""The training feature table: demand, duration, calendar and congestion features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession

from odflow.functions.calendar import calendar_features
from odflow.functions.scalars import zero_fill
from odflow.operators import quality
from odflow.operators.congestion import congestion_features, join_congestion, join_zones
from odflow.operators.demand import YEAR_ROWS, demand_features, duration_features
from odflow.session import materialise
from odflow.sources.tables import read_table, write_features


def feature_table(
    demand: DataFrame,
    routes: DataFrame,
    congestion: DataFrame,
    events: DataFrame | None = None,
    year_rows: int = YEAR_ROWS,
) -> DataFrame:
    """All features, unfilled.

    Calendar, routes and zone signals are added while the demand rows are narrow;
    the windows come last, so the wide rows are shuffled once, by route. Nothing
    before drops or repeats a row of a known route, hence the row-based windows
    see the same series either way.
    """
    zones = congestion_features(
        congestion.select("zone_id", "hour", "travel_time_var", "sample_count")
    )
    dated = calendar_features(demand, events)
    joined = join_congestion(join_zones(dated, routes), zones)
    return demand_features(duration_features(joined), year_rows)


def build_features(
    spark: SparkSession, warehouse: str, out: str, cutoff, events: DataFrame | None = None
) -> None:
    """Read the stored tables, check the features, fill them and write the snapshot."""
    demand = read_table(spark, warehouse, "demand")
    congestion = read_table(spark, warehouse, "congestion")
    if demand.isEmpty():
        raise ValueError("the demand table is empty")
    table = feature_table(demand, read_table(spark, warehouse, "routes"), congestion, events)
    # the checks that are aggregates of the table are taken while it is written
    observation = Observation()
    features = materialise(quality.watch(table, demand, observation))
    quality.assert_clean(quality.report(features, congestion, observation))
    write_features(zero_fill(features), out, cutoff)
