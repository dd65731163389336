"""Exploration tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.functions import scalars
from odflow.operators import congestion as signals
from odflow.operators import explore
from odflow.queries.base import query, with_tables
from odflow.queries.ingest import signals_table
from odflow.sources import driver_tables as src


def located(spark, folder):
    """Demand with the zones of its route."""
    return signals.join_zones(src.demand(spark, folder), src.routes(spark, folder))


def joined(spark, folder):
    return explore.joined_signals(located(spark, folder), signals_table(spark, folder))


TOD = """CASE WHEN hour(hour) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(hour) BETWEEN 12 AND 16 THEN 'midday'
              WHEN hour(hour) BETWEEN 17 AND 21 THEN 'evening' ELSE 'overnight' END"""


@query("time_of_day", f"SELECT event_id, {TOD.replace('hour(hour)', 'hour(ts)')} AS tod_bucket FROM events")
def time_of_day(spark, folder):
    return src.table(spark, folder, "events").select(
        "event_id", scalars.time_of_day(F.hour("ts")).alias("tod_bucket")
    )


@query(
    "coverage",
    with_tables(
        "demand routes congestion",
        """SELECT d.route_id, count(*) AS demand_hours, count(c.hour) AS matched_hours,
                  round(count(c.hour) / nullif(count(*), 0), 6) AS coverage_ratio
           FROM demand d JOIN routes r ON d.route_id = r.route_id
                LEFT JOIN congestion c ON c.zone_id = r.origin_zone_id AND c.hour = d.hour
           GROUP BY d.route_id""",
    ),
)
def coverage(spark, folder):
    return explore.coverage(located(spark, folder), signals_table(spark, folder))


@query("correlation", with_tables("joined", "SELECT round(corr(volume, travel_time_var), 6) AS corr FROM joined"))
def correlation(spark, folder):
    return explore.correlation(joined(spark, folder))


@query(
    "correlation_by_time_of_day",
    with_tables(
        "joined",
        f"SELECT {TOD} AS tod_bucket, round(corr(volume, travel_time_var), 6) AS corr FROM joined GROUP BY 1",
    ),
)
def correlation_by_time_of_day(spark, folder):
    return explore.correlation_by_time_of_day(joined(spark, folder))


@query(
    "correlation_by_route",
    with_tables(
        "joined",
        """SELECT route_id, round(c, 6) AS correlation
           FROM (SELECT route_id, corr(volume, travel_time_var) AS c FROM joined GROUP BY 1)
           WHERE c IS NOT NULL AND NOT isnan(c)""",
    ),
)
def correlation_by_route(spark, folder):
    return explore.correlation_by_route(joined(spark, folder))


@query(
    "lag_correlation",
    with_tables(
        "demand routes congestion",
        """SELECT CAST(k AS INTEGER) AS lag_hours, round(corr(d.volume, c.travel_time_var), 6) AS correlation
           FROM range(0, 7) t(k), demand d JOIN routes r ON d.route_id = r.route_id
                JOIN congestion c ON c.zone_id = r.origin_zone_id
                     AND c.hour + to_hours(CAST(k AS INTEGER)) = d.hour
           GROUP BY k HAVING count(*) > 10""",
    ),
)
def lag_correlation(spark, folder):
    return explore.lag_correlation(located(spark, folder), signals_table(spark, folder))


@query(
    "hourly_profile",
    with_tables(
        "demand",
        "SELECT CAST(hour(hour) AS INTEGER) AS hour_of_day, round(avg(volume), 6) AS avg_volume FROM demand GROUP BY 1",
    ),
)
def hourly_profile(spark, folder):
    return explore.hourly_profile(src.demand(spark, folder))


@query(
    "weekday_profile",
    with_tables(
        "demand",
        """SELECT CAST(dayofweek(hour) AS INTEGER) AS day_of_week, round(avg(volume), 6) AS avg_volume,
                  strftime(any_value(hour), '%a') AS dow_name FROM demand GROUP BY 1""",
    ),
)
def weekday_profile(spark, folder):
    return explore.weekday_profile(src.demand(spark, folder))


@query(
    "weekly_trend",
    with_tables(
        "demand",
        "SELECT CAST(date_trunc('week', hour) AS TIMESTAMP) AS week_start, round(avg(volume), 6) AS avg_volume FROM demand GROUP BY 1",
    ),
)
def weekly_trend(spark, folder):
    return explore.weekly_trend(src.demand(spark, folder))


@query(
    "monthly_counts",
    """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS count
       FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'
       GROUP BY 1""",
)
def monthly_counts(spark, folder):
    """Orders per month over a half-open range."""
    orders = src.table(spark, folder, "orders").select(F.col("o_orderdate").alias("hour"))
    return explore.monthly_counts(orders, "1996-01-01", "2001-01-01")


@query(
    "monthly_counts_all",
    "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS count FROM orders GROUP BY 1",
)
def monthly_counts_all(spark, folder):
    return explore.monthly_counts(src.table(spark, folder, "orders").select(F.col("o_orderdate").alias("hour")))


@query(
    "year_overlay",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
              CAST(sum(l_linenumber) AS BIGINT) AS total_volume
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def year_overlay(spark, folder):
    lines = src.table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("volume"))
    orders = src.table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("hour"))
    return explore.year_overlay(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))


@query(
    "describe_variance",
    with_tables(
        "congestion",
        """SELECT count(travel_time_var) AS count, round(avg(travel_time_var), 6) AS mean,
                  round(stddev_samp(travel_time_var), 6) AS std, round(min(travel_time_var), 6) AS min,
                  round(max(travel_time_var), 6) AS max FROM congestion""",
    ),
)
def describe_variance(spark, folder):
    return explore.describe(signals_table(spark, folder), "travel_time_var")


LEVELS = [0.5, 0.9, 0.95, 0.99]


@query(
    "variance_quantiles",
    with_tables(
        "congestion",
        " UNION ALL ".join(
            f"SELECT CAST({p} AS DOUBLE) AS quantile, round(quantile_cont(travel_time_var, {p}), 6) AS value FROM congestion"
            for p in LEVELS
        ),
    ),
)
def variance_quantiles(spark, folder):
    return explore.exact_quantiles(signals_table(spark, folder), "travel_time_var", LEVELS)


@query(
    "price_quantiles",
    " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS quantile, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem"
        for p in LEVELS
    ),
)
def price_quantiles(spark, folder):
    """The same over the largest table."""
    return explore.exact_quantiles(src.table(spark, folder, "lineitem"), "l_extendedprice", LEVELS)


def bins_sql(table: str, column: str, bins: int) -> str:
    return f"""SELECT CASE WHEN hi = lo THEN 0
                           ELSE CAST(least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) END AS bin,
                      count(*) AS count
               FROM (SELECT CAST({column} AS DOUBLE) AS v, min(CAST({column} AS DOUBLE)) OVER () AS lo,
                            max(CAST({column} AS DOUBLE)) OVER () AS hi FROM {table}) GROUP BY 1"""


@query("variance_histogram", with_tables("congestion", bins_sql("congestion", "travel_time_var", 50)))
def variance_histogram(spark, folder):
    return explore.histogram(signals_table(spark, folder), "travel_time_var", 50)


@query("volume_histogram", with_tables("demand", bins_sql("demand", "volume", 100)))
def volume_histogram(spark, folder):
    return explore.histogram(src.demand(spark, folder), "volume", 100)


@query(
    "route_histogram",
    with_tables("demand", bins_sql("o", "obs", 40), {"o": "SELECT count(*) AS obs FROM demand GROUP BY route_id"}),
)
def route_histogram(spark, folder):
    return explore.histogram(explore.route_observations(src.demand(spark, folder)), "obs", 40)


@query(
    "sigma_share",
    with_tables(
        "congestion",
        """SELECT round(any_value(lim), 6) AS sigma_limit,
                  round(100.0 * count_if(travel_time_var > lim) / count(*), 6) AS pct_above
           FROM congestion, (SELECT avg(travel_time_var) + 2 * stddev_samp(travel_time_var) AS lim FROM congestion)""",
    ),
)
def sigma_share(spark, folder):
    return explore.sigma_share(signals_table(spark, folder))


def flags(spark, folder):
    return explore.global_flags(signals_table(spark, folder))


@query("global_flags", with_tables("flags", "SELECT zone_id, hour, disruption_flag FROM flags"))
def global_flags(spark, folder):
    return flags(spark, folder)


RATES = """count(*) AS rows, CAST(sum(disruption_flag) AS BIGINT) AS flag_count,
           round(sum(disruption_flag) / count(*), 6) AS flag_rate FROM flags GROUP BY 1"""


@query("flags_by_zone", with_tables("flags", f"SELECT zone_id, {RATES}"))
def flags_by_zone(spark, folder):
    return explore.flags_by_zone(flags(spark, folder))


@query("flags_by_hour", with_tables("flags", f"SELECT CAST(hour(hour) AS INTEGER) AS hour_of_day, {RATES}"))
def flags_by_hour(spark, folder):
    return explore.flags_by_hour(flags(spark, folder))


@query(
    "flag_concentration",
    with_tables(
        "flags",
        """SELECT round(share, 6) AS share_pct, share >= 80 AS concentrated FROM (
               SELECT 100.0 * sum(f) / (SELECT sum(disruption_flag) FROM flags) AS share FROM (
                   SELECT sum(disruption_flag) AS f FROM flags GROUP BY zone_id
                   ORDER BY sum(disruption_flag) / count(*) DESC, zone_id LIMIT 5))""",
    ),
)
def flag_concentration(spark, folder):
    return explore.flag_concentration(flags(spark, folder))


@query(
    "signal_sparsity",
    with_tables(
        "congestion",
        "SELECT zone_id, count(*) AS active_hours, round(count(*) / 72.0, 6) AS coverage_ratio FROM congestion GROUP BY 1",
    ),
)
def signal_sparsity(spark, folder):
    return explore.signal_sparsity(signals_table(spark, folder))


@query(
    "route_strata",
    with_tables(
        "demand",
        """SELECT route_id, count(*) AS obs, count_if(volume < 10) AS sparse_cells,
                  CASE WHEN count(*) < 500 THEN 'sparse' ELSE 'dense' END AS stratum FROM demand GROUP BY 1""",
    ),
)
def route_strata(spark, folder):
    return explore.route_strata(src.demand(spark, folder))


OBS = "SELECT CAST(o_custkey AS BIGINT) AS route_id, count(*) AS obs FROM orders GROUP BY 1"


def customer_orders(spark, folder):
    orders = src.table(spark, folder, "orders").select(F.col("o_custkey").alias("route_id"))
    return explore.route_observations(orders)


@query("largest_routes", f"{OBS} ORDER BY obs DESC, route_id LIMIT 10")
def largest_routes(spark, folder):
    """Top ten keys by rows, over all customers of the orders."""
    return explore.extreme_routes(customer_orders(spark, folder), 10)


@query("sparsest_routes", f"{OBS} ORDER BY obs, route_id LIMIT 10")
def sparsest_routes(spark, folder):
    return explore.extreme_routes(customer_orders(spark, folder), 10, busiest=False)


@query(
    "busiest_routes",
    with_tables(
        "demand",
        """SELECT route_id, CAST(sum(volume) AS BIGINT) AS total_volume FROM demand
           GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    ),
)
def busiest_routes(spark, folder):
    return explore.busiest_routes(src.demand(spark, folder))


@query(
    "top_zone_map",
    with_tables(
        "order_trips",
        """SELECT n_nationkey AS zone_id, CAST(coalesce(v, 0) AS BIGINT) AS total_volume
           FROM nation LEFT JOIN (SELECT pu, count(*) AS v FROM order_trips GROUP BY 1
                                  ORDER BY 2 DESC, 1 LIMIT 10) ON pu = n_nationkey""",
    ),
)
def top_zone_map(spark, folder):
    volumes = src.order_trips(spark, folder).select(
        F.col("PULocationID").cast("int").alias("zone_id"), F.lit(1).alias("volume")
    )
    zones = src.table(spark, folder, "nation").select(F.col("n_nationkey").alias("zone_id"))
    return explore.top_zone_map(volumes, zones)


@query(
    "bounded_sample",
    """SELECT event_id, user_id, value FROM events
       ORDER BY md5('7:' || event_id), event_id LIMIT 1000""",
)
def bounded_sample(spark, folder):
    events = src.table(spark, folder, "events").select("event_id", "user_id", "value")
    return explore.bounded_sample(events, ["event_id"], 1000, seed="7")


@query(
    "table_profile",
    with_tables(
        "demand congestion",
        """SELECT 'demand' AS table_name, count(*) AS row_count, min(hour) AS min_hour, max(hour) AS max_hour FROM demand
           UNION ALL SELECT 'congestion', count(*), min(hour), max(hour) FROM congestion
           UNION ALL SELECT 'orders', count(*), min(o_orderdate), max(o_orderdate) FROM orders""",
    ),
)
def table_profile(spark, folder):
    return explore.table_profile(
        {
            "demand": src.demand(spark, folder),
            "congestion": signals_table(spark, folder),
            "orders": src.table(spark, folder, "orders").select(F.col("o_orderdate").alias("hour")),
        }
    )
