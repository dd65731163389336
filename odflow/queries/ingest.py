"""Sources, merges and trip aggregation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from odflow.functions import scalars
from odflow.operators import congestion as signals
from odflow.operators import demand as od
from odflow.queries.base import DEMAND_COLUMNS, listed, query, sql_flag, with_tables
from odflow.session import scratch_path
from odflow.sources import driver_tables as src
from odflow.sources import drift, tables, trips as trip_files, upserts

SECONDS = "greatest(date_sub('second', pickup_datetime, dropoff_datetime), 0)"
PAIRS = f"""
    SELECT pu, dof, date_trunc('hour', pickup_datetime) AS hour, count(*) AS pickup_count,
           avg({SECONDS}) AS avg_duration FROM {{trips}} GROUP BY 1, 2, 3"""


@query(
    "trip_scan",
    with_tables(
        "order_trips",
        """SELECT pickup_datetime, dropoff_datetime, pu AS "PULocationID", dof AS "DOLocationID",
                  trip_distance, fare_amount FROM order_trips
           WHERE date_trunc('month', pickup_datetime) = date_trunc('month', dropoff_datetime)""",
    ),
)
def trip_scan(spark, folder):
    """Monthly yellow files, written and read by the scan; the file of a trip is the month it was delivered in."""
    trips = src.order_trips(spark, folder).select(*trip_files.TRIP_COLUMNS)
    raw = trips.withColumnsRenamed({name: alias for alias, name in trip_files.TIME_ALIASES["yellow"].items()})
    path = scratch_path(spark, "trips")
    months = raw.withColumns({"color": F.lit("yellow"), "month": F.date_format("tpep_dropoff_datetime", "yyyy-MM")})
    months.hint("rebalance", "month").write.partitionBy("color", "month").parquet(path)
    least, most = trips.agg(F.min("pickup_datetime"), F.max("pickup_datetime")).first()
    after = dt.date(most.year + most.month // 12, most.month % 12 + 1, 1)
    span = trip_files.month_range(after, (most.year - least.year) * 12 + most.month - least.month + 1)
    layout = "color={color}/month={year:04d}-{month:02d}"
    return trip_files.scan(spark, path, ["yellow"], span, layout=layout).select(*trip_files.TRIP_COLUMNS)


@query(
    "month_range",
    """WITH a AS (SELECT date_trunc('month', max(o_orderdate)) AS m FROM orders),
            s AS (SELECT CAST(m - to_months(CAST(k AS INTEGER)) AS DATE) AS month_start
                  FROM a, range(1, 25) t(k))
       SELECT month_start, CAST(year(month_start) AS INTEGER) AS year,
              CAST(month(month_start) AS INTEGER) AS month FROM s""",
)
def month_range(spark, folder):
    newest = src.table(spark, folder, "orders").agg(F.max("o_orderdate").cast("date").alias("as_of"))
    return trip_files.month_starts(newest, 24)


@query(
    "csv_stop_map",
    """SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, s_nationkey AS zone_id
       FROM supplier WHERE s_suppkey % 9 <> 0""",
)
def csv_stop_map(spark, folder):
    """Stop map lines as CSV text; every ninth line lacks its zone."""
    stops = src.table(spark, folder, "supplier")
    zone = F.when(F.col("s_suppkey") % 9 != 0, F.col("s_nationkey").cast("string")).otherwise("")
    lines = stops.select(F.concat_ws(",", F.col("s_suppkey").cast("string"), zone).alias("line"))
    return tables.parse_csv(lines, "line", tables.STOP_MAP, ["stop_id", "zone_id"])


def event_payloads(spark, folder):
    """JSON documents built from ``events``: bare objects, unreadable dates and good lists."""
    key = F.get_json_object("props", "$.k").cast("int")
    day = F.date_format(F.date_add(F.col("ts").cast("date"), key), "yyyy-MM-dd")
    kind = F.pmod("event_id", F.lit(4))
    item = '{"event_start_date": "%s"}'
    text = (
        F.when(kind == 0, F.format_string(item, day))
        .when(kind == 1, F.format_string(f"[{item}]", F.lit("soon")))
        .when(kind == 2, F.format_string(f'[{item}, {{"k": 1}}]', F.concat(day, F.lit("T00:00:00.000"))))
        .otherwise(F.format_string(f'[{{"event_start_date": null}}, {item}]', day))
    )
    return src.table(spark, folder, "events").select(text.alias("payload"))


@query("event_dates", with_tables("event_days", "SELECT event_date FROM event_days"))
def event_dates(spark, folder):
    return tables.event_dates(event_payloads(spark, folder), "payload")


@query(
    "event_rejects",
    """WITH k AS (SELECT event_id % 6 AS kind, CAST(ts AS DATE) + CAST(json_extract_string(props, '$.k') AS INTEGER) AS day FROM events)
       SELECT CASE WHEN kind IN (0, 1) THEN day END AS event_date,
              CASE kind WHEN 2 THEN 'wrong type' WHEN 3 THEN 'no date' WHEN 4 THEN 'not a list' WHEN 5 THEN 'not JSON' END AS reason,
              count(*) AS items FROM k GROUP BY 1, 2""",
)
def event_rejects(spark, folder):
    """Items of event documents of drifting shape by their date, or by the reason why they have none."""
    key = F.get_json_object("props", "$.k").cast("int")
    day = F.date_format(F.date_add(F.col("ts").cast("date"), key), "yyyy-MM-dd")
    kind = F.pmod("event_id", F.lit(6))
    text = (
        F.when(kind == 0, F.format_string('[{"event_start_date": "%s"}]', day))
        .when(kind == 1, F.format_string('[{"event_start_date": "%sT00:00:00.000", "venue": {"name": ["x"]}}]', day))
        .when(kind == 2, F.format_string('[{"event_start_date": {"day": "%s"}}]', day))
        .when(kind == 3, F.format_string('[{"event_start": "%s"}]', day))
        .when(kind == 4, F.format_string('{"event_start_date": "%s"}', day))
        .otherwise(F.format_string('[{"event_start_date": "%s"', day))
    )
    rows = drift.read_events(src.table(spark, folder, "events").select(text.alias("body")), "body")
    return rows.groupBy("event_date", "reason").agg(F.count(F.lit(1)).alias("items"))


def stored_routes(spark, folder):
    """A route from each nation to the next one."""
    nation = F.col("n_nationkey")
    return src.table(spark, folder, "nation").select(
        (nation + 1).alias("route_id"),
        nation.alias("origin_zone_id"),
        F.pmod(nation + 1, F.lit(25)).alias("destination_zone_id"),
    )


@query(
    "new_routes",
    with_tables(
        "order_trips",
        """SELECT CAST(25 + row_number() OVER (ORDER BY v DESC, pu, dof) AS INTEGER) AS route_id,
                  pu AS origin_zone_id, dof AS destination_zone_id
           FROM (SELECT pu, dof, count(*) / (SELECT count(DISTINCT date_trunc('month', pickup_datetime))
                                             FROM order_trips) AS v
                 FROM order_trips GROUP BY 1, 2)
           WHERE v > 1 AND (pu + 1) % 25 <> dof""",
    ),
)
def new_routes(spark, folder):
    selected = od.selected_routes(src.order_trips(spark, folder), threshold=1)
    return upserts.new_routes(stored_routes(spark, folder), selected)


@query(
    "demand_upsert",
    with_tables(
        "trips demand routes",
        """, n AS (SELECT route_id, hour, pickup_count AS volume, coalesce(avg_duration, 0) AS avg_duration
                   FROM new_pairs JOIN routes ON pu = origin_zone_id AND dof = destination_zone_id)
           SELECT route_id, hour, volume, round(avg_duration, 6) AS avg_duration FROM n
           UNION ALL
           SELECT d.route_id, d.hour, d.volume, round(d.avg_duration, 6) FROM demand d
           WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.route_id = d.route_id AND n.hour = d.hour)""",
        {"green": "SELECT * FROM trips WHERE color = 'green'",
         "new_pairs": PAIRS.format(trips="green")},
    ),
)
def demand_upsert(spark, folder):
    """The demand table after the green trips were loaded again."""
    green = src.event_trips(spark, folder).filter("color = 'green'")
    return upserts.merge_demand(
        src.demand(spark, folder), od.hourly_pairs(green), src.routes(spark, folder)
    )


@query(
    "congestion_upsert",
    with_tables(
        "congestion",
        """SELECT zone_id, hour, round(travel_time_var, 6) AS travel_time_var, sample_count,
                  false AS disruption_flag FROM fresh
           UNION ALL
           SELECT zone_id, hour, round(travel_time_var, 6), sample_count, sample_count < 10
           FROM congestion c WHERE NOT EXISTS
                (SELECT 1 FROM fresh f WHERE f.zone_id = c.zone_id AND f.hour = c.hour)""",
        {"fresh": """SELECT user_id % 7 AS zone_id, date_trunc('hour', ts) AS hour,
                            coalesce(var_samp(value), 0.0) AS travel_time_var, count(value) AS sample_count
                     FROM events WHERE event_type = 'error' GROUP BY 1, 2"""},
    ),
)
def congestion_upsert(spark, folder):
    stored = signals_table(spark, folder).withColumn("disruption_flag", F.col("sample_count") < 10)
    errors = src.table(spark, folder, "events").filter("event_type = 'error'")
    fresh = signals.zone_variance(
        errors.select(
            F.pmod("user_id", F.lit(7)).alias("zone_id"),
            scalars.hour_of(F.col("ts")).alias("hour"),
            F.col("value").alias("segment_travel_time"),
        )
    )
    return upserts.merge_congestion(stored, fresh)


def signals_table(spark, folder):
    """The congestion table derived from ``events``."""
    samples = src.zone_samples(spark, folder)
    return signals.zone_variance(samples.withColumn("hour", scalars.hour_of(F.col("timestamp"))))


def delay_table(spark, folder):
    return signals.zone_delays(
        src.stop_delays(spark, folder), src.stop_map(spark, folder), scalars.hour_of(F.col("polled_at"))
    )


@query(
    "weighted_merge",
    with_tables(
        "delay_parts",
        """SELECT zone_id, hour, 'all' AS feed_id,
                  round(sum(mean_delay * trip_count) / sum(trip_count), 6) AS mean_delay,
                  CAST(sum(trip_count) AS BIGINT) AS trip_count
           FROM delay_parts GROUP BY 1, 2""",
    ),
)
def weighted_merge(spark, folder):
    """The per-feed rows merged as if they were repeated polls of one feed."""
    return upserts.merge_delays(delay_table(spark, folder).withColumn("feed_id", F.lit("all")))


@query(
    "flag_updates",
    with_tables(
        "congestion",
        """SELECT zone_id, hour, new_flag AS disruption_flag
           FROM (SELECT zone_id, hour, sample_count >= 3 AS old_flag, CAST(%s AS BOOLEAN) AS new_flag
                 FROM congestion)
           WHERE new_flag <> old_flag""" % sql_flag(),
    ),
)
def flag_updates(spark, folder):
    stored = signals_table(spark, folder).withColumn("disruption_flag", F.col("sample_count") >= 3)
    return upserts.flag_updates(stored, signals.congestion_features(stored))


@query(
    "missing_days",
    """WITH s AS (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY))
                              AS DATE) AS day FROM orders)
       SELECT day FROM s WHERE day NOT IN
            (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F')""",
)
def missing_days(spark, folder):
    orders = src.table(spark, folder, "orders")
    span = orders.agg(
        F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end")
    )
    return upserts.missing_days(span, orders.filter("o_orderstatus = 'F'"), "o_orderdate")


@query(
    "feature_snapshot",
    with_tables(
        "demand",
        f"SELECT route_id, hour, volume, round(avg_duration, 6) AS avg_duration, {listed(DEMAND_COLUMNS)}"
        " FROM demand",
    ),
)
def feature_snapshot(spark, folder):
    """Demand features written for one training cutoff and read back."""
    path = scratch_path(spark, "features")
    features = od.demand_features(src.demand(spark, folder), year_rows=168)
    tables.write_features(features, path, F.lit("2024-01-31"))
    return tables.read_features(spark, path, "2024-01-31")


@query(
    "table_projection",
    """SELECT o_orderkey AS route_id, o_orderdate AS hour, o_totalprice AS volume FROM orders""",
)
def table_projection(spark, folder):
    """A stored demand table with further columns, read through the projection."""
    path = scratch_path(spark, "warehouse")
    src.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("route_id"),
        F.col("o_orderdate").alias("hour"),
        F.col("o_totalprice").alias("volume"),
        F.lit(None).cast("double").alias("avg_duration"),
        "o_orderstatus",
    ).write.parquet(f"{path}/demand")
    return tables.read_table(spark, path, "demand").drop("avg_duration")


@query(
    "trip_duration",
    with_tables("trips", f"SELECT pickup_datetime, dropoff_datetime, {SECONDS} AS duration FROM trips"),
)
def trip_duration(spark, folder):
    timed = scalars.with_trip_seconds(src.event_trips(spark, folder))
    return timed.select("pickup_datetime", "dropoff_datetime", "duration")


@query("hour_truncation", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def hour_truncation(spark, folder):
    return src.table(spark, folder, "events").select("event_id", scalars.hour_of(F.col("ts")).alias("hour"))


@query(
    "hourly_pairs",
    with_tables(
        "trips",
        f"""SELECT pu AS "PULocationID", dof AS "DOLocationID", hour, pickup_count,
                   round(avg_duration, 6) AS avg_duration FROM ({PAIRS.format(trips='trips')})""",
    ),
)
def hourly_pairs(spark, folder):
    return od.hourly_pairs(src.event_trips(spark, folder))


@query(
    "daily_pairs",
    with_tables(
        "order_trips",
        f"""SELECT pu AS "PULocationID", dof AS "DOLocationID", hour, pickup_count,
                   round(avg_duration, 6) AS avg_duration FROM ({PAIRS.format(trips='order_trips')})""",
    ),
)
def daily_pairs(spark, folder):
    """The same aggregate over the four-table trip join."""
    return od.hourly_pairs(src.order_trips(spark, folder))


COMBINED = """
    SELECT pu, dof, hour, CAST(sum(pickup_count) AS BIGINT) AS pickup_count,
           round(avg(avg_duration), 6) AS avg_duration
    FROM (SELECT pu, dof, color, date_trunc('hour', pickup_datetime) AS hour, count(*) AS pickup_count,
                 avg(%s) AS avg_duration FROM trips GROUP BY ALL)
    GROUP BY 1, 2, 3""" % SECONDS


@query(
    "combine_colors",
    with_tables(
        "trips",
        f"""SELECT pu AS "PULocationID", dof AS "DOLocationID", hour, pickup_count, avg_duration
            FROM ({COMBINED})""",
    ),
)
def combine_colors(spark, folder):
    return od.combined_pairs(src.event_trips(spark, folder), ["yellow", "green"])


@query(
    "combine_colors_weighted",
    with_tables(
        "trips",
        f"""SELECT pu AS "PULocationID", dof AS "DOLocationID", hour, pickup_count,
                   round(avg_duration, 6) AS avg_duration FROM ({PAIRS.format(trips='trips')})""",
    ),
)
def combine_colors_weighted(spark, folder):
    return od.combined_pairs(src.event_trips(spark, folder), ["yellow", "green"], weighted=True)


@query(
    "route_selection",
    with_tables(
        "order_trips",
        """SELECT pu AS "PULocationID", dof AS "DOLocationID", trips, round(v, 6) AS avg_monthly_volume
           FROM (SELECT pu, dof, count(*) AS trips,
                        count(*) / (SELECT count(DISTINCT date_trunc('month', pickup_datetime))
                                    FROM order_trips) AS v
                 FROM order_trips GROUP BY 1, 2) WHERE v > 1""",
    ),
)
def route_selection(spark, folder):
    return od.selected_routes(src.order_trips(spark, folder), threshold=1)


@query(
    "route_resolution",
    with_tables(
        "trips routes",
        """SELECT pu AS "PULocationID", dof AS "DOLocationID", hour, pickup_count,
                  round(avg_duration, 6) AS avg_duration, route_id
           FROM pairs JOIN routes ON pu = origin_zone_id AND dof = destination_zone_id""",
        {"pairs": PAIRS.format(trips="trips")},
    ),
)
def route_resolution(spark, folder):
    return od.resolve_routes(
        od.hourly_pairs(src.event_trips(spark, folder)), src.routes(spark, folder)
    )


@query(
    "union_trips",
    with_tables(
        "trips order_trips",
        """SELECT pu AS "PULocationID", dof AS "DOLocationID", color, count(*) AS trips,
                  count(trip_distance) AS with_distance
           FROM (SELECT pu, dof, color, NULL AS trip_distance FROM trips
                 UNION ALL SELECT pu, dof, color, trip_distance FROM order_trips) GROUP BY 1, 2, 3""",
    ),
)
def union_trips(spark, folder):
    """Frames with different columns, stacked."""
    both = src.event_trips(spark, folder).unionByName(
        src.order_trips(spark, folder), allowMissingColumns=True
    )
    return both.groupBy("PULocationID", "DOLocationID", "color").agg(
        F.count(F.lit(1)).alias("trips"), F.count("trip_distance").alias("with_distance")
    )
