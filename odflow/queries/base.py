"""Registry, result rounding and the SQL text shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, folder)`` under ``name``, with its SQL.

    Doubles are rounded to ``digits`` places on both sides.
    """

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return settle(fn(use_utc(spark), folder), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Means over 24 values of two decimals end after up to seven decimals, so that
# rounding them to six would decide exact ties.
DIGITS = {"duration_rolling_mean_3h": 8, "duration_rolling_mean_24h": 8}


def settle(df: DataFrame, digits: int = 6) -> DataFrame:
    """Results in comparable types: small integers as int, doubles rounded."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType)):
            column = column.cast("int")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), DIGITS.get(field.name, digits))
        columns.append(column.alias(field.name))
    return df.select(*columns)


# Every table an oracle may start from, as SQL over the driver tables.
TABLES = {
    "trips": """
        SELECT ts AS pickup_datetime,
               ts + to_microseconds(CAST(round((value - 20) * 60000000) AS BIGINT)) AS dropoff_datetime,
               user_id % 5 AS pu, (user_id // 5) % 2 + 5 AS dof,
               CASE WHEN event_type IN ('click', 'view') THEN 'yellow' ELSE 'green' END AS color
        FROM events""",
    "order_trips": """
        SELECT o_orderdate AS pickup_datetime, l_shipdate AS dropoff_datetime,
               CAST(c_nationkey AS BIGINT) AS pu, CAST(s_nationkey AS BIGINT) AS dof,
               l_quantity AS trip_distance, l_extendedprice AS fare_amount,
               CASE WHEN l_linestatus = 'F' THEN 'yellow' ELSE 'green' END AS color
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "routes": """
        SELECT DISTINCT user_id % 10 + 1 AS route_id, user_id % 5 AS origin_zone_id,
               (user_id // 5) % 2 + 5 AS destination_zone_id FROM events""",
    "demand": """
        SELECT user_id % 10 + 1 AS route_id, date_trunc('hour', ts) AS hour,
               count(*) AS volume, avg(value) AS avg_duration
        FROM events GROUP BY 1, 2""",
    "congestion": """
        SELECT user_id % 7 AS zone_id, date_trunc('hour', ts) AS hour,
               coalesce(var_samp(value), 0.0) AS travel_time_var, count(value) AS sample_count
        FROM events GROUP BY 1, 2""",
    "delay_parts": """
        SELECT s_nationkey AS zone_id, date_trunc('hour', ts) AS hour, event_type AS feed_id,
               avg(value) AS mean_delay, count(value) AS trip_count
        FROM events JOIN supplier ON user_id = s_suppkey GROUP BY 1, 2, 3""",
    "joined": """
        SELECT d.route_id, d.hour, CAST(d.volume AS DOUBLE) AS volume, c.travel_time_var
        FROM demand d JOIN routes r ON d.route_id = r.route_id
             JOIN congestion c ON c.zone_id = r.origin_zone_id AND c.hour = d.hour""",
    "flags": """
        SELECT zone_id, hour,
               CASE WHEN travel_time_var > (SELECT avg(travel_time_var) + 2 * stddev_pop(travel_time_var)
                                            FROM congestion) THEN 1 ELSE 0 END AS disruption_flag
        FROM congestion""",
    "days": """
        SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2027-12-31', INTERVAL 1 DAY)) AS DATE) AS d""",
    "fixed_days": """
        SELECT d FROM days
        WHERE (month(d), day(d)) IN ((1, 1), (7, 4), (11, 11), (12, 25))
           OR (month(d) = 6 AND day(d) = 19 AND year(d) >= 2021)""",
    "holidays": """
        SELECT d FROM fixed_days
        UNION SELECT CAST(d - INTERVAL 1 DAY AS DATE) FROM fixed_days WHERE isodow(d) = 6
        UNION SELECT CAST(d + INTERVAL 1 DAY AS DATE) FROM fixed_days WHERE isodow(d) = 7
        UNION SELECT d FROM days WHERE isodow(d) = 1 AND (
            (month(d) = 1 AND day(d) BETWEEN 15 AND 21 AND year(d) >= 1986)
            OR (month(d) = 2 AND day(d) BETWEEN 15 AND 21)
            OR (month(d) = 5 AND day(d) BETWEEN 25 AND 31)
            OR (month(d) = 9 AND day(d) BETWEEN 1 AND 7)
            OR (month(d) = 10 AND day(d) BETWEEN 8 AND 14))
        UNION SELECT d FROM days WHERE isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28""",
    "next_holiday": """
        SELECT a.d, min(h.d - a.d) AS gap FROM days a
             JOIN holidays h ON h.d BETWEEN a.d AND a.d + INTERVAL 120 DAY GROUP BY a.d""",
    "event_days": """
        SELECT DISTINCT CAST(ts AS DATE) + CAST(json_extract_string(props, '$.k') AS INTEGER) AS event_date
        FROM events WHERE event_id % 4 IN (2, 3)""",
    "edges": """
        WITH c(i, ax, ay, bx, b_y) AS (VALUES
            (1, 0.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 1.0, 0.5), (3, 1.0, 0.5, 0.5, 0.5),
            (4, 0.5, 0.5, 0.5, 1.0), (5, 0.5, 1.0, 0.0, 1.0), (6, 0.0, 1.0, 0.0, 0.0))
        SELECT n_nationkey AS zone_id,
               CAST(n_nationkey % 5 + ax AS DOUBLE) AS x1, CAST(n_nationkey // 5 + ay AS DOUBLE) AS y1,
               CAST(n_nationkey % 5 + bx AS DOUBLE) AS x2, CAST(n_nationkey // 5 + b_y AS DOUBLE) AS y2
        FROM nation, c""",
    "positions": """
        SELECT event_id, ts, (event_id * 7919 % 500) / 100.0 AS longitude,
               (CAST(round(value * 100) AS BIGINT) % 500) / 100.0 AS latitude, value
        FROM events""",
    "stops": """
        SELECT CAST(c_custkey AS VARCHAR) AS stop_id, (c_custkey * 7919 % 500) / 100.0 AS stop_lon,
               ((CAST(round(c_acctbal * 100) AS BIGINT) % 500 + 500) % 500) / 100.0 AS stop_lat
        FROM customer""",
}
NEEDS = {
    "joined": ["demand", "routes", "congestion"],
    "flags": ["congestion"],
    "fixed_days": ["days"],
    "holidays": ["fixed_days"],
    "next_holiday": ["holidays"],
}


def with_tables(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind a WITH list of the named tables, then of ``extra``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{name} AS ({TABLES[name]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return f"WITH {', '.join(parts)}{'' if body.lstrip().startswith(',') else ' '}{body}"


def frame(rows: int, key: str = "route_id") -> str:
    return f"(PARTITION BY {key} ORDER BY hour ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


def sql_lag(column: str, rows: int, key: str = "route_id") -> str:
    return f"lag({column}, {rows}) OVER (PARTITION BY {key} ORDER BY hour)"


def sql_mean(column: str, rows: int, key: str = "route_id") -> str:
    w = frame(rows, key)
    return f"CASE WHEN count({column}) OVER {w} = {rows} THEN avg({column}) OVER {w} END"


def sql_trend(column: str = "volume", key: str = "route_id") -> str:
    past = (
        f"list(CAST({column} AS DOUBLE)) OVER (PARTITION BY {key} ORDER BY hour"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    return f"list_reduce({past}, lambda a, v : a * 23 / 25 + v * 2 / 25)"


def sql_flag(column: str = "travel_time_var", key: str = "zone_id") -> str:
    w = frame(168, key)
    return (
        f"CASE WHEN count({column}) OVER {w} = 168 THEN CAST({column} > avg({column}) OVER {w}"
        f" + 2 * coalesce(stddev_samp({column}) OVER {w}, 0) AS INTEGER) END"
    )


def rounded(expr: str, name: str) -> str:
    return f"round({expr}, {DIGITS.get(name, 6)}) AS {name}"


DEMAND_COLUMNS = {
    **{f"lag_{n}h": sql_lag("volume", n) for n in (1, 2, 3, 24, 48, 72, 96, 120, 144, 168)},
    **{f"rolling_mean_{n}h": sql_mean("volume", n) for n in (3, 24, 168, 336)},
    "ewm_trend_24h": sql_trend(),
    "yoy_ratio": (
        f"CASE WHEN {sql_lag('volume', 168)} IS NOT NULL THEN"
        f" least(greatest(volume / greatest({sql_lag('volume', 168)}, 0.001), 0.01), 100.0) END"
    ),
}
DURATION_COLUMNS = {
    **{f"duration_lag_{n}h": sql_lag("avg_duration", n) for n in (1, 24, 168)},
    **{f"duration_rolling_mean_{n}h": sql_mean("avg_duration", n) for n in (3, 24)},
}
ZONE_COLUMNS = {
    "delay_index_lag1": sql_lag("travel_time_var", 1, "zone_id"),
    "delay_index_rolling3h": sql_mean("travel_time_var", 3, "zone_id"),
    "low_confidence_flag": "CAST(sample_count < 10 AS INTEGER)",
    "disruption_flag": sql_flag(),
}
CALENDAR_COLUMNS = {
    "dow": "CAST(isodow(hour) AS INTEGER)",
    "hour_of_day": "CAST(hour(hour) AS INTEGER)",
    "month": "CAST(month(hour) AS INTEGER)",
    "week_of_year": "CAST(weekofyear(hour) AS INTEGER)",
    "is_weekend": "CAST(isodow(hour) >= 6 AS INTEGER)",
    "days_to_next_us_holiday": "CAST(gap AS INTEGER)",
}
RECURRING = "strftime({day}, '%m-%d') IN ('01-01', '03-17', '07-04', '11-01', '12-31')"


def listed(columns: dict[str, str], digits: bool = True) -> str:
    whole = ("low_confidence_flag", "disruption_flag", "lag_")
    return ", ".join(
        f"{e} AS {n}" if (not digits or n.startswith(whole)) else rounded(e, n)
        for n, e in columns.items()
    )
