"""Batch forecasts for a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.functions.scalars import forecast_key, split_requests
from odflow.operators import conformal, serving
from odflow.operators.asof import congestion_at
from odflow.operators.boosting import QuantileBoost
from odflow.operators.forest import QuantileForest


def forecast_steps(
    model: QuantileForest | QuantileBoost,
    routes: DataFrame,
    demand: DataFrame,
    congestion: DataFrame,
    as_of: Column,
    hours: Column | int,
    events: DataFrame | None = None,
) -> DataFrame:
    """``(route_id, step, p10, p50, p90)`` for every route, hour by hour."""
    static = serving.static_features(routes, demand, congestion)
    matrix = serving.horizon_matrix(static, hours, as_of, events, single=False)
    scored = model.predict(serving.training_view(matrix))
    return scored.select(
        "route_id", F.col("horizon_hours").cast("int").alias("step"), "p10", "p50", "p90"
    )


def _in_order(step: Column, quantile: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(step.alias("step"), F.col(quantile))))
    return F.transform(pairs, lambda pair: pair[quantile])


def answer_requests(
    requests: DataFrame,
    model: QuantileForest | QuantileBoost,
    routes: DataFrame,
    demand: DataFrame,
    congestion: DataFrame,
    as_of: Column,
    events: DataFrame | None = None,
    margins: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Forecast lists per distinct forecast key, and the rejected requests.

    ``margins`` per day ahead, from :mod:`odflow.operators.conformal`, widen the intervals.

    Equal keys are answered once; a route is scored once, for the longest
    horizon asked of it. The lists have at most 168 entries.
    """
    accepted, rejected = split_requests(requests, routes)
    zones = congestion.select("zone_id")
    origin = serving.latest_congestion(congestion, zones).select(
        F.col("zone_id").alias("origin_zone_id"), "travel_time_var"
    )
    keyed = (
        accepted.select("route_id", "horizon")
        .distinct()
        .join(routes.select("route_id", "origin_zone_id", "destination_zone_id"), "route_id")
        .join(origin, "origin_zone_id", "left")
        .withColumn(
            "forecast_key",
            forecast_key(
                F.col("route_id"), F.col("horizon"), F.coalesce("travel_time_var", F.lit(0.0))
            ),
        )
        .select("route_id", "horizon", "forecast_key")
    )
    asked = accepted.groupBy("route_id").agg(F.max("horizon").alias("_days"))
    wanted = routes.join(asked, "route_id")
    static = serving.static_features(wanted, demand, congestion).join(asked, "route_id")
    matrix = serving.horizon_matrix(static, (F.col("_days") * 24).cast("int"), as_of, events, single=False)
    scored = model.predict(serving.training_view(matrix))
    step = F.col("horizon_hours").cast("int")
    if margins is not None:
        scored = conformal.calibrate(scored.withColumn("horizon", F.ceil(step / 24).cast("int")), margins).drop("horizon")
    lists = [_in_order(step, q).alias(q) for q in ("p10", "p50", "p90")]
    answered = (
        keyed.join(scored.select("route_id", "horizon_hours", "p10", "p50", "p90"), "route_id")
        .filter(step <= F.col("horizon") * 24)
        .groupBy("route_id", "horizon", "forecast_key")
        .agg(*lists)
    )
    return answered, rejected


def past_keys(requests: DataFrame, routes: DataFrame, congestion: DataFrame, max_age: str | None = None) -> DataFrame:
    """The valid requests of a log with ``as_of``, with the forecast key that each had at its own time."""
    accepted, _ = split_requests(requests, routes)
    placed = accepted.join(routes.select("route_id", F.col("origin_zone_id").alias("zone_id")), "route_id")
    known = congestion_at(placed, congestion, max_age=max_age)
    key = forecast_key(F.col("route_id"), F.col("horizon"), F.col("travel_time_var"))
    return known.select(*requests.columns, key.alias("forecast_key"), "travel_time_var", "sample_count")
