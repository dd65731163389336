"""Window, calendar and joined features."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.functions import calendar, scalars
from odflow.operators import congestion as signals
from odflow.operators import demand as od
from odflow.operators import quality
from odflow.plans.features import feature_table
from odflow.queries.base import (
    CALENDAR_COLUMNS,
    DEMAND_COLUMNS,
    DURATION_COLUMNS,
    RECURRING,
    ZONE_COLUMNS,
    listed,
    query,
    rounded,
    sql_flag,
    with_tables,
)
from odflow.queries.ingest import delay_table, event_payloads, signals_table
from odflow.session import materialise
from odflow.sources import driver_tables as src
from odflow.sources import tables

LAGS = [c for c in DEMAND_COLUMNS if c.startswith("lag_")]
MEANS = [c for c in DEMAND_COLUMNS if c.startswith("rolling_")]
ZONES = "zone_id, hour, round(travel_time_var, 6) AS travel_time_var, sample_count"


def pick(columns, names):
    return {n: columns[n] for n in names}


def some(df, names):
    return df.select("route_id", "hour", *names)


def demand_features(spark, folder):
    return od.demand_features(src.demand(spark, folder), year_rows=168)


@query("demand_lags", with_tables("demand", f"SELECT route_id, hour, {listed(pick(DEMAND_COLUMNS, LAGS))} FROM demand"))
def demand_lags(spark, folder):
    return some(demand_features(spark, folder), LAGS)


@query(
    "demand_rolling_means",
    with_tables("demand", f"SELECT route_id, hour, {listed(pick(DEMAND_COLUMNS, MEANS))} FROM demand"),
)
def demand_rolling_means(spark, folder):
    return some(demand_features(spark, folder), MEANS)


@query(
    "ewm_trend",
    with_tables(
        "demand", f"SELECT route_id, hour, {rounded(DEMAND_COLUMNS['ewm_trend_24h'], 'ewm_trend_24h')} FROM demand"
    ),
)
def ewm_trend(spark, folder):
    return some(demand_features(spark, folder), ["ewm_trend_24h"])


@query(
    "year_over_year",
    with_tables("demand", f"SELECT route_id, hour, {rounded(DEMAND_COLUMNS['yoy_ratio'], 'yoy_ratio')} FROM demand"),
)
def year_over_year(spark, folder):
    """The ratio to the value 168 rows back: the tables hold one month, not a year."""
    return some(demand_features(spark, folder), ["yoy_ratio"])


@query(
    "demand_features",
    with_tables(
        "demand",
        f"SELECT route_id, hour, volume, round(avg_duration, 6) AS avg_duration, {listed(DEMAND_COLUMNS)} FROM demand",
    ),
)
def all_demand_features(spark, folder):
    return demand_features(spark, folder)


@query(
    "duration_features",
    with_tables("demand", f"SELECT route_id, hour, {listed(DURATION_COLUMNS)} FROM demand"),
)
def duration_features(spark, folder):
    return some(od.duration_features(src.demand(spark, folder)), list(DURATION_COLUMNS))


@query(
    "routed_demand_features",
    with_tables(
        "trips routes",
        f"SELECT route_id, hour, volume, {listed(DEMAND_COLUMNS)} FROM routed",
        {
            "routed": """SELECT route_id, date_trunc('hour', pickup_datetime) AS hour, count(*) AS volume
                         FROM trips JOIN routes ON pu = origin_zone_id AND dof = destination_zone_id
                         GROUP BY 1, 2"""
        },
    ),
)
def routed_demand_features(spark, folder):
    """From trips to features: aggregate by pair and hour, name the route, add the windows."""
    hourly = od.hourly_pairs(src.event_trips(spark, folder))
    routed = od.resolve_routes(hourly, src.routes(spark, folder))
    demand = routed.select("route_id", "hour", F.col("pickup_count").alias("volume"))
    return od.demand_features(demand, year_rows=168)


@query(
    "zone_variance",
    with_tables("congestion", f"SELECT {ZONES} FROM congestion"),
)
def zone_variance(spark, folder):
    return signals_table(spark, folder)


@query(
    "zone_delays",
    with_tables(
        "delay_parts",
        "SELECT zone_id, hour, feed_id, round(mean_delay, 6) AS mean_delay, trip_count FROM delay_parts",
    ),
)
def zone_delays(spark, folder):
    return delay_table(spark, folder)


@query(
    "stop_lookup",
    """SELECT CAST(user_id AS VARCHAR) AS stop_id, value AS delay, s_nationkey AS zone_id
       FROM events JOIN supplier ON user_id = s_suppkey""",
)
def stop_lookup(spark, folder):
    delays = src.stop_delays(spark, folder).select("stop_id", "delay")
    return delays.join(src.stop_map(spark, folder), "stop_id")


@query(
    "recent_delay",
    with_tables(
        "delay_parts",
        """SELECT n_nationkey AS zone_id, round(coalesce(d, 0.0), 6) AS recent_delay
           FROM nation LEFT JOIN (
                SELECT zone_id, sum(mean_delay * trip_count) / nullif(sum(trip_count), 0) AS d
                FROM delay_parts WHERE hour > (SELECT max(hour) FROM delay_parts) - INTERVAL 1 HOUR
                GROUP BY 1) ON zone_id = n_nationkey""",
    ),
)
def recent_delay(spark, folder):
    """As of the newest hour with a delay."""
    delays = delay_table(spark, folder)
    zones = src.table(spark, folder, "nation").select(F.col("n_nationkey").alias("zone_id"))
    return signals.recent_delay(delays, zones, delays.agg(F.max("hour")).scalar())


@query("congestion_features", with_tables("congestion", f"SELECT {ZONES}, {listed(ZONE_COLUMNS)} FROM congestion"))
def congestion_features(spark, folder):
    return signals.congestion_features(signals_table(spark, folder))


@query("disruption_flag", with_tables("congestion", f"SELECT zone_id, hour, {sql_flag()} AS disruption_flag FROM congestion"))
def disruption_flag(spark, folder):
    return signals.congestion_features(signals_table(spark, folder)).select("zone_id", "hour", "disruption_flag")


@query(
    "low_confidence",
    with_tables("congestion", "SELECT zone_id, hour, CAST(sample_count < 10 AS INTEGER) AS low_confidence_flag FROM congestion"),
)
def low_confidence(spark, folder):
    return signals_table(spark, folder).select(
        "zone_id", "hour", scalars.low_confidence(F.col("sample_count")).alias("low_confidence_flag")
    )


@query(
    "route_zones",
    with_tables(
        "demand routes",
        """SELECT d.route_id, hour, volume, round(avg_duration, 6) AS avg_duration, origin_zone_id,
                  destination_zone_id FROM demand d JOIN routes r ON d.route_id = r.route_id""",
    ),
)
def route_zones(spark, folder):
    return signals.join_zones(src.demand(spark, folder), src.routes(spark, folder))


@query(
    "dual_congestion_join",
    with_tables(
        "demand routes congestion",
        """SELECT d.route_id, d.hour, d.volume, r.origin_zone_id, r.destination_zone_id,
                  round(o.travel_time_var, 6) AS origin_travel_time_var, o.sample_count AS origin_sample_count,
                  round(e.travel_time_var, 6) AS dest_travel_time_var, e.sample_count AS dest_sample_count
           FROM demand d JOIN routes r ON d.route_id = r.route_id
                LEFT JOIN congestion o ON o.zone_id = r.origin_zone_id AND o.hour = d.hour
                LEFT JOIN congestion e ON e.zone_id = r.destination_zone_id AND e.hour = d.hour""",
    ),
)
def dual_congestion_join(spark, folder):
    demand = signals.join_zones(src.demand(spark, folder).drop("avg_duration"), src.routes(spark, folder))
    return signals.join_congestion(demand, signals_table(spark, folder))


@query(
    "calendar_features",
    with_tables(
        "next_holiday event_days",
        f"""SELECT hour, {", ".join(f"{e} AS {n}" for n, e in CALENDAR_COLUMNS.items())},
                   CAST({RECURRING.format(day='hour')} OR event_date IS NOT NULL AS INTEGER) AS nyc_event_flag
            FROM (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events)
                 JOIN next_holiday n ON n.d = CAST(hour AS DATE)
                 LEFT JOIN event_days ON event_date = CAST(hour AS DATE)""",
    ),
)
def calendar_features(spark, folder):
    hours = src.table(spark, folder, "events").select(scalars.hour_of(F.col("ts")).alias("hour")).distinct()
    events = tables.event_dates(event_payloads(spark, folder), "payload")
    return calendar.calendar_features(hours, events)


CYCLES = {
    "hour_sin": "sin(2 * pi() * hour(t) / 24)",
    "hour_cos": "cos(2 * pi() * hour(t) / 24)",
    "dow_sin": "sin(2 * pi() * (isodow(t) - 1) / 7)",
    "dow_cos": "cos(2 * pi() * (isodow(t) - 1) / 7)",
    "month_sin": "sin(2 * pi() * (month(t) - 1) / 12)",
    "month_cos": "cos(2 * pi() * (month(t) - 1) / 12)",
}
SERVING_CALENDAR = f"""
    CAST(hour(t) AS DOUBLE) AS hour_of_day, CAST(isodow(t) - 1 AS DOUBLE) AS dow,
    CAST(month(t) AS DOUBLE) AS month, CAST(weekofyear(t) AS DOUBLE) AS week_of_year,
    CAST(isodow(t) >= 6 AS DOUBLE) AS is_weekend, CAST(gap AS DOUBLE) AS days_to_next_us_holiday,
    CAST({RECURRING.format(day='t')} AS DOUBLE) AS nyc_event_flag,
    {", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in CYCLES.items())}"""


@query(
    "serving_calendar",
    with_tables(
        "next_holiday",
        f"""SELECT t, {SERVING_CALENDAR}
            FROM (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events)
                 JOIN next_holiday n ON n.d = CAST(t AS DATE)""",
    ),
)
def serving_calendar(spark, folder):
    hours = src.table(spark, folder, "events").select(scalars.hour_of(F.col("ts")).alias("t")).distinct()
    return calendar.serving_calendar(hours, "t")


@query(
    "days_to_holiday",
    with_tables(
        "next_holiday",
        """SELECT o_orderkey, CAST(gap AS INTEGER) AS days_to_next_us_holiday
           FROM orders JOIN next_holiday n ON n.d = CAST(o_orderdate AS DATE)""",
    ),
)
def days_to_holiday(spark, folder):
    return src.table(spark, folder, "orders").select(
        "o_orderkey",
        calendar.days_to_next_holiday(F.col("o_orderdate").cast("date")).alias("days_to_next_us_holiday"),
    )


@query(
    "event_flag",
    with_tables(
        "event_days",
        f"""SELECT o_orderkey, CAST({RECURRING.format(day='o_orderdate')}
                   OR CAST(o_orderdate AS DATE) IN (SELECT event_date FROM event_days) AS INTEGER) AS event_flag
            FROM orders""",
    ),
)
def event_flag(spark, folder):
    orders = src.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    events = tables.event_dates(event_payloads(spark, folder), "payload")
    day = F.col("o_orderdate").cast("date")
    return calendar.with_event_flag(orders, day, events, "event_flag").drop("o_orderdate")


@query(
    "event_dates_union",
    with_tables(
        "event_days",
        f"""SELECT event_date FROM event_days
            UNION SELECT CAST(o_orderdate AS DATE) FROM orders WHERE {RECURRING.format(day='o_orderdate')}""",
    ),
)
def event_dates_union(spark, folder):
    """Published dates and the recurring days that occur in the orders."""
    day = F.col("o_orderdate").cast("date")
    recurring = src.table(spark, folder, "orders").filter(calendar.recurring_event(day)).select(
        day.alias("event_date")
    )
    published = tables.event_dates(event_payloads(spark, folder), "payload")
    return published.union(recurring).distinct()


@query(
    "warm_up_base",
    with_tables(
        "demand",
        """SELECT route_id, hour, min(hour) OVER (PARTITION BY route_id) AS start_hour,
                  hour - min(hour) OVER (PARTITION BY route_id) >= INTERVAL 168 HOUR AS warm
           FROM demand""",
    ),
)
def warm_up_base(spark, folder):
    started = quality.since_start(src.demand(spark, folder).select("route_id", "hour"))
    return started.withColumn("warm", F.col("hour") - F.col("start_hour") >= F.expr("interval 168 hours"))


ZONE_SQL = with_tables(
    "demand routes congestion next_holiday",
    "",
    {"zones": f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in ZONE_COLUMNS.items())} FROM congestion"},
).rstrip()
SIDES = ["travel_time_var", "sample_count", *ZONE_COLUMNS]


def side_sql(prefix, alias, fill):
    out = []
    for c in SIDES:
        e = f"{alias}.{c}"
        e = f"coalesce({e}, 0)" if fill else e
        if c.startswith(("travel", "delay")):
            e = f"round({e}, 6)"
        out.append(f"{e} AS {prefix}_{c}")
    return ", ".join(out)


def features_sql(fill: bool) -> str:
    def wrap(e, n):
        whole = n.startswith("lag_") or n in CALENDAR_COLUMNS or n == "volume"
        e = f"coalesce({e}, 0)" if fill else e
        return f"{e} AS {n}" if whole else rounded(e, n)

    own = {"volume": "volume", "avg_duration": "avg_duration", **DEMAND_COLUMNS, **DURATION_COLUMNS}
    inner = ", ".join(f"{e} AS {n}" for n, e in {**DEMAND_COLUMNS, **DURATION_COLUMNS}.items())
    outer = ", ".join(wrap(f"f.{n}", n) for n in own)
    return f"""{ZONE_SQL}, f AS (SELECT *, {inner} FROM demand)
        SELECT f.route_id, f.hour, r.origin_zone_id, r.destination_zone_id, {outer},
               {", ".join(f"{e.replace('hour)', 'f.hour)')} AS {n}" for n, e in CALENDAR_COLUMNS.items())},
               CAST({RECURRING.format(day='f.hour')} AS INTEGER) AS nyc_event_flag,
               {side_sql('origin', 'o', fill)}, {side_sql('dest', 'e', fill)}
        FROM f JOIN routes r ON f.route_id = r.route_id
             LEFT JOIN zones o ON o.zone_id = r.origin_zone_id AND o.hour = f.hour
             LEFT JOIN zones e ON e.zone_id = r.destination_zone_id AND e.hour = f.hour
             JOIN next_holiday n ON n.d = CAST(f.hour AS DATE)"""


def features(spark, folder):
    return feature_table(
        src.demand(spark, folder), src.routes(spark, folder), signals_table(spark, folder), year_rows=168
    )


@query("feature_table", features_sql(fill=False))
def all_features(spark, folder):
    """The whole training table, unfilled."""
    return features(spark, folder)


@query("zero_fill", features_sql(fill=True))
def zero_fill(spark, folder):
    """The training table with nulls as 0."""
    return scalars.zero_fill(features(spark, folder))


@query(
    "drop_incomplete",
    with_tables(
        "demand",
        f"""SELECT route_id, hour, volume, round(avg_duration, 6) AS avg_duration, lag_168h, rolling_mean_168h
            FROM (SELECT *, {listed(pick(DEMAND_COLUMNS, ['lag_168h', 'rolling_mean_168h']))} FROM demand)
            WHERE lag_168h IS NOT NULL AND rolling_mean_168h IS NOT NULL""",
    ),
)
def drop_incomplete(spark, folder):
    wide = demand_features(spark, folder)
    return scalars.drop_incomplete(
        wide.select("route_id", "hour", "volume", "avg_duration", "lag_168h", "rolling_mean_168h")
    )


SIGNALS = [f"{p}_{c}" for p in ("origin", "dest") for c in
           ("delay_index_lag1", "delay_index_rolling3h", "low_confidence_flag", "disruption_flag")]
ALL_COLUMNS = (
    ["route_id", "hour", "volume", "avg_duration", "origin_zone_id", "destination_zone_id"]
    + list(DEMAND_COLUMNS) + list(DURATION_COLUMNS) + list(CALENDAR_COLUMNS) + ["nyc_event_flag"]
    + [f"{p}_{c}" for p in ("origin", "dest") for c in SIDES]
)


def report_sql() -> str:
    def row(check, subject, value, status):
        return f"""SELECT '{check}' AS "check", '{subject}' AS subject,
                          CAST(round({value}, 6) AS DOUBLE) AS value, {status} AS status FROM f"""

    info = "'info'"
    rows = [row("rows", "features", "count(*)", info)]
    for c in SIGNALS:
        rows.append(row("all_null", c, f"count({c})",
                        f"CASE WHEN count(*) > 100 AND count({c}) = 0 THEN 'fail' ELSE 'ok' END"))
    flag = "origin_disruption_flag"
    rows.append(row("variance", flag, f"var_samp({flag})",
                    f"CASE WHEN count(*) > 200 AND coalesce(var_samp({flag}), 0) = 0 THEN 'warn' ELSE 'ok' END"))
    for c in quality.KEY_FEATURES:
        rows += [row("min", c, f"min({c})", info), row("max", c, f"max({c})", info)]
    for c in ALL_COLUMNS:
        rate = f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)"
        status = f"CASE WHEN {rate} > 0.05 THEN 'warn' ELSE 'ok' END" if "lag" in c or "rolling" in c else info
        rows.append(row("null_rate", c, rate, status).replace("FROM f", "FROM warm"))
    rows.append("""SELECT 'leakage', 'origin_delay_index_lag1', CAST(count_if(
                          abs(f.origin_delay_index_lag1 - c.travel_time_var) > 1e-5) AS DOUBLE),
                          CASE WHEN count_if(abs(f.origin_delay_index_lag1 - c.travel_time_var) > 1e-5) > 0
                               THEN 'fail' ELSE 'ok' END
                   FROM f JOIN congestion c ON c.zone_id = f.origin_zone_id
                        AND c.hour = f.hour - INTERVAL 1 HOUR""")
    rows.append("""SELECT * FROM (SELECT 'route_rows', CAST(route_id AS VARCHAR), CAST(count(*) AS DOUBLE), 'info'
                   FROM f GROUP BY route_id ORDER BY count(*) DESC, route_id LIMIT 5)""")
    base = features_sql(fill=False)
    head, tail = base.split(", f AS (", 1)
    return (
        f"{head}, f AS (WITH f AS ({tail}), "
        "warm AS (SELECT * FROM (SELECT *, min(hour) OVER (PARTITION BY route_id) AS h0 FROM f)"
        " WHERE hour >= h0 + INTERVAL 168 HOUR) " + " UNION ALL ".join(rows)
    )


@query("quality_report", report_sql())
def quality_report(spark, folder):
    table = materialise(features(spark, folder))
    return quality.report(table, signals_table(spark, folder))


@query(
    "key_checks",
    """SELECT 'primary_key' AS "check", 'lineitem' AS subject, CAST(count_if(c > 1) AS DOUBLE) AS value,
              CASE WHEN count_if(c > 1) > 0 THEN 'fail' ELSE 'ok' END AS status
       FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
       UNION ALL
       SELECT 'non_negative', 'lineitem.l_quantity', CAST(count_if(l_quantity < 0) AS DOUBLE),
              CASE WHEN count_if(l_quantity < 0) > 0 THEN 'fail' ELSE 'ok' END FROM lineitem""",
)
def key_checks(spark, folder):
    lines = src.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return quality.key_checks(lines, ["l_orderkey", "l_linenumber"], "lineitem", ["l_quantity"])
