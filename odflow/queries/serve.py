"""Forecast-time features and batch forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.functions import scalars
from odflow.operators import serving
from odflow.operators.sequences import sequence_windows
from odflow.operators import validation as val
from odflow.functions.calendar import calendar_features
from odflow.operators.asof import last_known
from odflow.plans.forecast import answer_requests, forecast_steps, past_keys
from odflow.plans.training import train_forest
from odflow.queries.base import DEMAND_COLUMNS, DURATION_COLUMNS, query, with_tables
from odflow.queries.features import SERVING_CALENDAR, features
from odflow.queries.ingest import signals_table
from odflow.queries.validate import forecast_checks, training_data
from odflow.sources import driver_tables as src

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def request_table(spark, folder):
    """One request per order, some for unknown routes or impossible horizons."""
    return src.table(spark, folder, "orders").select(
        F.pmod("o_custkey", F.lit(13)).alias("route_id"),
        F.pmod("o_orderkey", F.lit(9)).cast("int").alias("horizon"),
    )


REQUESTS = "SELECT o_custkey % 13 AS route_id, CAST(o_orderkey % 9 AS INTEGER) AS horizon FROM orders"


@query(
    "request_validation",
    with_tables(
        "routes",
        f"""SELECT q.route_id, horizon, CASE WHEN q.route_id < 1 THEN 'route_id must be at least 1'
                        WHEN horizon NOT BETWEEN 1 AND 7 THEN 'horizon must be between 1 and 7 days'
                        WHEN r.route_id IS NULL THEN 'route not found' ELSE 'accepted' END AS reason
            FROM ({REQUESTS}) q LEFT JOIN routes r ON q.route_id = r.route_id""",
    ),
)
def request_validation(spark, folder):
    accepted, rejected = scalars.split_requests(request_table(spark, folder), src.routes(spark, folder))
    return accepted.withColumn("reason", F.lit("accepted")).unionByName(rejected)


@query(
    "forecast_key",
    """SELECT event_id, round_even(value / 10, 0) * 10 AS bucket,
              'forecast:' || user_id || ':' || event_id % 7 + 1 || ':' || CAST(round_even(value / 10, 0) * 10 AS BIGINT) || '.0'
                  AS forecast_key
       FROM events""",
)
def forecast_key(spark, folder):
    events = src.table(spark, folder, "events")
    return events.select(
        "event_id",
        scalars.congestion_bucket(F.col("value")).alias("bucket"),
        scalars.forecast_key(
            F.col("user_id"), F.pmod("event_id", F.lit(7)) + 1, F.col("value")
        ).alias("forecast_key"),
    )


@query(
    "latest_congestion",
    with_tables(
        "congestion",
        """SELECT n_nationkey AS zone_id, round(coalesce(v, 0.0), 6) AS travel_time_var, coalesce(s, 0) AS sample_count
           FROM nation LEFT JOIN (SELECT zone_id, arg_max(travel_time_var, hour) AS v, arg_max(sample_count, hour) AS s
                                  FROM congestion GROUP BY 1) ON zone_id = n_nationkey""",
    ),
)
def latest_congestion(spark, folder):
    zones = src.table(spark, folder, "nation").select(F.col("n_nationkey").alias("zone_id"))
    return serving.latest_congestion(signals_table(spark, folder), zones)


def ranked(table: str, key: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY hour DESC) AS rn FROM {table})
               WHERE rn <= 168"""


def text_list(column, digits: int):
    """Arrays as text, so that results compare as plain values."""
    return F.array_join(F.transform(column, lambda v: F.format_string(f"%.{digits}f", v.cast("double"))), ",")


@query(
    "demand_history",
    with_tables(
        "demand",
        f"""SELECT route_id, string_agg(printf('%.0f', CAST(volume AS DOUBLE)), ',' ORDER BY hour) AS volumes,
                   string_agg(printf('%.4f', coalesce(avg_duration, 0.0) + 0.00001), ',' ORDER BY hour) AS durations
            FROM ({ranked('demand', 'route_id')}) GROUP BY 1""",
    ),
)
def demand_history(spark, folder):
    """Last 168 rows per route; durations are shifted off the rounding ties."""
    history = serving.demand_history(src.demand(spark, folder))
    shifted = history.withColumn("durations", F.transform("durations", lambda v: v + 0.00001))
    return shifted.select(
        "route_id", text_list("volumes", 0).alias("volumes"), text_list("durations", 4).alias("durations")
    )


@query(
    "congestion_history",
    with_tables(
        "congestion",
        f"""SELECT zone_id, string_agg(printf('%.2f', travel_time_var + 0.001), ',' ORDER BY hour) AS travel_time_vars
            FROM ({ranked('congestion', 'zone_id')}) GROUP BY 1""",
    ),
)
def congestion_history(spark, folder):
    history = serving.congestion_history(signals_table(spark, folder))
    shifted = F.transform("travel_time_vars", lambda v: v + 0.001)
    return history.withColumn("travel_time_vars", shifted).select(
        "zone_id", text_list("travel_time_vars", 2).alias("travel_time_vars")
    )


def at(column: str, rank: int) -> str:
    return f"coalesce(max({column}) FILTER (rn = {rank}), 0)"


def recent(column: str, rows: int) -> str:
    return f"coalesce(avg({column}) FILTER (rn <= {rows}), 0)"


def seeded(span: int) -> str:
    alpha = 2.0 / (span + 1.0)
    values = "list(CAST(volume AS DOUBLE) ORDER BY hour)"
    return f"list_reduce({values}, lambda a, v : {alpha!r} * v + {1.0 - alpha!r} * a)"


ROUTE_STATE = {
    **{f"lag_{n}h": f"CAST({at('volume', n)} AS DOUBLE)" for n in serving.LAGS},
    **{f"rolling_mean_{n}h": recent("volume", n) for n in serving.WINDOWS},
    **{f"duration_lag_{n}h": at("avg_duration", n) for n in serving.DURATION_LAGS},
    **{f"duration_rolling_mean_{n}h": recent("avg_duration", n) for n in serving.DURATION_WINDOWS},
    **{f"ewm_trend_{n}h": seeded(n) for n in serving.TREND_SPANS},
    "yoy_ratio": "0.0::DOUBLE",
}
DIGITS8 = ("duration_rolling",)


def fixed(columns: dict[str, str]) -> str:
    return ", ".join(f"round({e}, {8 if n.startswith(DIGITS8) else 6}) AS {n}" for n, e in columns.items())


@query(
    "route_state",
    with_tables("demand", f"SELECT route_id, {fixed(ROUTE_STATE)} FROM ({ranked('demand', 'route_id')}) GROUP BY 1"),
)
def route_state(spark, folder):
    return serving.route_state(src.demand(spark, folder))


VALUE = "travel_time_var"
ZONE_STATE = {
    "delay_index": at(VALUE, 1),
    "delay_index_lag1": at(VALUE, 1),
    "delay_index_lag24": at(VALUE, 24),
    "delay_index_rolling3h": recent(VALUE, 3),
    "disruption_flag": f"CAST(count(*) >= 168 AND {at(VALUE, 1)} > avg({VALUE}) + 2 * stddev_pop({VALUE}) AS DOUBLE)",
    "low_confidence_flag": f"CAST({at('sample_count', 1)} < 10 AS DOUBLE)",
}


@query(
    "zone_state",
    with_tables("congestion", f"SELECT zone_id, {fixed(ZONE_STATE)} FROM ({ranked('congestion', 'zone_id')}) GROUP BY 1"),
)
def zone_state(spark, folder):
    return serving.zone_state(signals_table(spark, folder))


def static(spark, folder):
    return serving.static_features(
        src.routes(spark, folder), src.demand(spark, folder), signals_table(spark, folder)
    )


STATES = {
    "route_state": f"SELECT route_id, {fixed(ROUTE_STATE)} FROM ({ranked('demand', 'route_id')}) GROUP BY 1",
    "zone_state": f"SELECT zone_id, {fixed(ZONE_STATE)} FROM ({ranked('congestion', 'zone_id')}) GROUP BY 1",
    "static": "SELECT r.route_id, r.origin_zone_id, r.destination_zone_id, s.* EXCLUDE (route_id), "
    + ", ".join(f"{a}.{c} AS {p}_{c}" for p, a in (("origin", "o"), ("dest", "e")) for c in ZONE_STATE)
    + """ FROM routes r JOIN route_state s ON r.route_id = s.route_id
              JOIN zone_state o ON o.zone_id = r.origin_zone_id JOIN zone_state e ON e.zone_id = r.destination_zone_id""",
}


@query("serving_static", with_tables("demand routes congestion", "SELECT * FROM static", STATES))
def serving_static(spark, folder):
    return static(spark, folder)


@query(
    "horizon_matrix",
    with_tables(
        "demand routes congestion next_holiday",
        f"""SELECT {", ".join(serving.SERVING_FEATURES)}
            FROM (SELECT *, {SERVING_CALENDAR}
                  FROM (SELECT *, CAST(k AS DOUBLE) AS horizon_hours,
                               TIMESTAMP '{AS_OF}' + to_hours(CAST(k AS INTEGER)) AS t
                        FROM static, range(1, 169) s(k)) JOIN next_holiday n ON n.d = CAST(t AS DATE))""",
        STATES,
    ),
)
def horizon_matrix(spark, folder):
    """All 54 slots of the next seven days for every route."""
    return serving.horizon_matrix(static(spark, folder), 168, as_of(), single=False)


STEPS = """SELECT route_id, CAST(k AS INTEGER) AS step, 0.5 * (lag_24h + lag_168h) AS p10, lag_24h + lag_168h AS p50,
                  1.5 * (lag_24h + lag_168h) + k / 100.0 AS p90 FROM static, range(1, 169) s(k)"""


class LastDay:
    """A stand-in for a fitted model whose forecasts SQL can state."""

    def predict(self, df):
        middle = F.col("lag_24h") + F.col("lag_168h")
        return df.withColumns(
            {"p10": middle * 0.5, "p50": middle, "p90": middle * 1.5 + F.col("horizon_hours") / 100.0}
        )


def simple_steps(spark, folder):
    return forecast_steps(
        LastDay(), src.routes(spark, folder), src.demand(spark, folder), signals_table(spark, folder), as_of(), 168
    )


@query(
    "fan_chart",
    with_tables(
        "demand routes congestion",
        "SELECT route_id, step, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM steps WHERE step <= 72",
        {**STATES, "steps": STEPS},
    ),
)
def fan_chart(spark, folder):
    return serving.fan_chart(simple_steps(spark, folder), 3)


@query(
    "headline",
    with_tables(
        "demand routes congestion",
        "SELECT route_id, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM steps WHERE step = 1",
        {**STATES, "steps": STEPS},
    ),
)
def headline(spark, folder):
    return serving.headline(simple_steps(spark, folder))


SKEWED = ["lag_1h", "lag_2h", "lag_3h", "lag_24h", "lag_168h", "rolling_mean_3h", "rolling_mean_24h",
          "rolling_mean_168h", "ewm_trend_24h", "yoy_ratio", "duration_lag_1h", "duration_lag_24h",
          "duration_lag_168h", "duration_rolling_mean_3h", "duration_rolling_mean_24h"]


def skew_sql() -> str:
    columns = {**DEMAND_COLUMNS, **DURATION_COLUMNS}
    batch = ", ".join(f"{columns[c]} AS {c}" for c in SKEWED)
    raw = ", ".join(f"{ROUTE_STATE[c]} AS {c}" for c in SKEWED)
    rows = [
        f"""SELECT '{c}' AS feature, count(abs(b.{c} - s.{c})) AS compared,
                   count_if(abs(b.{c} - s.{c}) > 0.000001) AS different,
                   round(max(abs(b.{c} - s.{c})), 6) + 0.0 AS max_abs_diff FROM b JOIN s ON b.route_id = s.route_id"""
        for c in SKEWED
    ]
    return with_tables(
        "demand",
        " UNION ALL ".join(rows),
        {
            "b": f"SELECT * FROM (SELECT *, {batch} FROM demand) WHERE hour = (SELECT max(hour) FROM demand)",
            "past": "SELECT * FROM demand WHERE hour < (SELECT max(hour) FROM demand)",
            "s": f"SELECT route_id, {raw} FROM ({ranked('past', 'route_id')}) GROUP BY 1",
        },
    )


@query("skew_report", skew_sql())
def skew_report(spark, folder):
    """Training features of the newest hour against serving features of the rows before it."""
    demand = src.demand(spark, folder)
    newest = demand.agg(F.max("hour")).scalar()
    batch = features(spark, folder).filter(F.col("hour") == newest)
    return serving.skew_report(batch, serving.route_state(demand.filter(F.col("hour") < newest)), SKEWED)


def sequence_input(spark, folder):
    demand = src.demand(spark, folder).select("route_id", "hour", "volume")
    return calendar_features(demand.join(val.hour_index(demand), "hour"))


@query(
    "sequence_windows",
    with_tables(
        "demand",
        """SELECT route_id, hour, time_idx, round(center, 6) AS center, round(scale, 6) AS scale, past_rows, future_rows,
                  CAST(past_sum AS BIGINT) AS past_sum, past_first, CAST(future_sum AS BIGINT) AS future_sum, future_last
           FROM (SELECT route_id, hour, time_idx, avg(volume) OVER r AS center, stddev_samp(volume) OVER r AS scale,
                        CAST(count(*) OVER p AS INTEGER) AS past_rows, CAST(count(*) OVER q AS INTEGER) AS future_rows,
                        sum(volume) OVER p AS past_sum, first_value(volume) OVER p AS past_first,
                        sum(volume) OVER q AS future_sum, last_value(volume) OVER q AS future_last
                 FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY hour) - 1 AS INTEGER) AS time_idx FROM demand)
                 WINDOW r AS (PARTITION BY route_id),
                        p AS (PARTITION BY route_id ORDER BY hour ROWS BETWEEN 335 PRECEDING AND CURRENT ROW),
                        q AS (PARTITION BY route_id ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 168 FOLLOWING))
           WHERE past_rows >= 168 AND future_rows >= 1""",
    ),
)
def sequence_digest(spark, folder):
    """Encoder and decoder windows, with sums and ends of their target values."""
    windows = sequence_windows(sequence_input(spark, folder), unknown=["volume"])

    def total(column):
        return F.aggregate(column, F.lit(0).cast("long"), lambda a, s: a + s["volume"])

    return windows.select(
        "route_id", "hour", "time_idx", "center", "scale",
        F.size("past").alias("past_rows"), F.size("future").alias("future_rows"),
        total("past").alias("past_sum"), F.col("past")[0]["volume"].alias("past_first"),
        total("future").alias("future_sum"), F.element_at("future", -1)["volume"].alias("future_last"),
    )


def list_sql(quantile: str) -> str:
    return f"string_agg(printf('%.2f', {quantile} + 0.001), ',' ORDER BY step) AS {quantile}"


@query(
    "batch_forecast_lists",
    with_tables(
        "demand routes congestion",
        f"""SELECT q.route_id, horizon,
                   'forecast:' || q.route_id || ':' || horizon || ':'
                   || CAST(round_even(any_value(origin_delay_index) / 10, 0) * 10 AS BIGINT) || '.0' AS forecast_key,
                   {list_sql('p10')}, {list_sql('p50')}, {list_sql('p90')}
            FROM (SELECT DISTINCT * FROM ({REQUESTS})) q JOIN static ON static.route_id = q.route_id
                 JOIN steps ON steps.route_id = q.route_id AND step <= horizon * 24
            WHERE horizon BETWEEN 1 AND 7 AND q.route_id >= 1 GROUP BY q.route_id, horizon""",
        {**STATES, "steps": STEPS},
    ),
)
def batch_forecast_lists(spark, folder):
    """The whole batch path, from requests to lists, with the stand-in model."""
    answered, _ = answer_requests(
        request_table(spark, folder), LastDay(), src.routes(spark, folder), src.demand(spark, folder),
        signals_table(spark, folder), as_of(),
    )
    lists = {q: text_list(F.transform(q, lambda v: v + 0.001), 2) for q in ("p10", "p50", "p90")}
    return answered.withColumns(lists)


@query(
    "batch_forecast",
    with_tables(
        "demand routes congestion",
        """SELECT q.route_id, horizon,
                  'forecast:' || q.route_id || ':' || horizon || ':'
                  || CAST(round_even(origin_delay_index / 10, 0) * 10 AS BIGINT) || '.0' AS forecast_key,
                  horizon * 24 AS n_p10, horizon * 24 AS n_p50, horizon * 24 AS n_p90, true AS ordered
           FROM (SELECT DISTINCT * FROM (%s)) q JOIN static ON static.route_id = q.route_id
           WHERE horizon BETWEEN 1 AND 7 AND q.route_id >= 1""" % REQUESTS,
        STATES,
    ),
)
def batch_forecast(spark, folder):
    """Forecast lists of a fitted model for the request table: their lengths, and whether the levels are in order."""
    train, _ = training_data(spark, folder)
    model = train_forest(train)
    answered, _ = answer_requests(
        request_table(spark, folder), model, src.routes(spark, folder), src.demand(spark, folder),
        signals_table(spark, folder), as_of(),
    )
    triples = F.arrays_zip("p10", "p50", "p90")
    return answered.select(
        "route_id", "horizon", "forecast_key", *[F.size(q).alias(f"n_{q}") for q in val.QUANTILES],
        F.forall(triples, lambda t: (t["p10"] <= t["p50"]) & (t["p50"] <= t["p90"])).alias("ordered"),
    )


@query(
    "forecast_steps",
    with_tables(
        "demand routes congestion",
        "SELECT route_id, step, true AS ordered, true AS in_range FROM steps",
        {**STATES, "steps": STEPS},
    ),
)
def all_steps(spark, folder):
    """Seven days of forecasts of a fitted model for every route, with their order and range checked."""
    train, _ = training_data(spark, folder)
    steps = forecast_steps(
        train_forest(train), src.routes(spark, folder), src.demand(spark, folder),
        signals_table(spark, folder), as_of(), 168,
    )
    return steps.withColumns(forecast_checks(train)).select("route_id", "step", "ordered", "in_range")


KNOWN = "(SELECT zone_id, hour + INTERVAL 1 HOUR AS known_at, travel_time_var, sample_count FROM congestion%s)"


@query(
    "point_in_time",
    with_tables(
        "congestion",
        f"""SELECT event_id, e.zone_id,
                   CASE WHEN ts <= known_at + INTERVAL 6 HOUR THEN round(travel_time_var, 6) END AS travel_time_var
            FROM (SELECT event_id, ts, user_id % 8 AS zone_id FROM events) e
                 ASOF LEFT JOIN {KNOWN % " WHERE sample_count >= 3"} c ON e.zone_id = c.zone_id AND ts >= known_at""",
    ),
)
def point_in_time(spark, folder):
    """The last variance from three samples or more that was known when each event came in, at most six hours old."""
    asked = src.table(spark, folder, "events").select("event_id", "ts", F.pmod("user_id", F.lit(8)).alias("zone_id"))
    value = F.when(F.col("sample_count") >= 3, F.col("travel_time_var")).alias("travel_time_var")
    known = signals_table(spark, folder).select("zone_id", (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("known_at"), value)
    found = last_known(asked, known, ["zone_id"], "ts", "known_at", ["travel_time_var"], "6 HOURS")
    return found.select("event_id", "zone_id", "travel_time_var")


@query(
    "past_forecast_keys",
    with_tables(
        "routes congestion",
        f"""SELECT event_id, q.route_id, horizon,
                   'forecast:' || q.route_id || ':' || horizon || ':'
                   || CAST(round_even(coalesce(travel_time_var, 0) / 10, 0) * 10 AS BIGINT) || '.0' AS forecast_key,
                   CAST(coalesce(sample_count, 0) AS BIGINT) AS sample_count
            FROM (SELECT event_id, r.route_id, CAST(event_id % 9 AS INTEGER) AS horizon, ts, origin_zone_id
                  FROM events JOIN routes r ON r.route_id = user_id % 13 WHERE event_id % 9 BETWEEN 1 AND 7) q
                 ASOF LEFT JOIN {KNOWN % ""} c ON q.origin_zone_id = c.zone_id AND q.ts >= known_at""",
    ),
)
def past_forecast_keys(spark, folder):
    """The key under which a forecast asked for at each event's time would have been kept."""
    asked = src.table(spark, folder, "events").select(
        "event_id", F.pmod("user_id", F.lit(13)).alias("route_id"), F.pmod("event_id", F.lit(9)).cast("int").alias("horizon"),
        F.col("ts").alias("as_of"),
    )
    keys = past_keys(asked, src.routes(spark, folder), signals_table(spark, folder))
    return keys.select("event_id", "route_id", "horizon", "forecast_key", "sample_count")
