"""Seasonal-trend decomposition and the comparison of stored forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.operators import bootstrap, sketches, stl
from odflow.operators import validation as val
from odflow.operators.gaps import gap_days, gap_ranges
from odflow.operators.seasonal import seasonal_forecast
from odflow.queries.base import query, with_tables
from odflow.queries.validate import CUT, SEASONAL, naive_forecast, naive_sql, split_demand
from odflow.session import materialise, scratch_path, small_side
from odflow.sources import driver_tables as src


def lines_sql(source: str, keys: str, x: str, value: str, half: int, step: int) -> str:
    """Tricube-weighted local lines of ``value`` over ``x`` at the anchors ``a * step``."""
    return f"""
        SELECT {keys}, a, CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s0
                               THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS line
        FROM (SELECT {keys}, a, sum(k) AS s0, sum(k * d) AS s1, sum(k * d * d) AS s2, sum(k * v) AS t0, sum(k * d * v) AS t1
              FROM (SELECT *, (1 - abs(d) ** 3) ** 3 AS k
                    FROM (SELECT *, (x - a * {step}) / {half}.0 AS d
                          FROM (SELECT {keys}, {x} AS x, CAST({value} AS DOUBLE) AS v,
                                       unnest(generate_series(CAST(ceil(({x} - {half - 1}) / {step}) AS BIGINT),
                                                              CAST(floor(({x} + {half - 1}) / {step}) AS BIGINT))) AS a
                                FROM {source})))
              GROUP BY {keys}, a)"""


def smooth_sql(source: str, lines: str, step: int, out: str) -> str:
    return f"""
        SELECT s.*, p.line + (q.line - p.line) * (s.x - p.a * {step}) / {step} AS {out}
        FROM {source} s LEFT JOIN {lines} p ON p.route_id = s.route_id AND p.a = s.x // {step}
                        LEFT JOIN {lines} q ON q.route_id = s.route_id AND q.a = s.x // {step} + 1"""


STL = {
    "series": """SELECT route_id, hour, CAST(volume AS DOUBLE) AS volume, x, x % 168 AS phase, x // 168 AS cycle
                 FROM (SELECT *, CAST(epoch(hour) AS BIGINT) // 3600 AS x FROM demand)""",
    "cycle_lines": lines_sql("series", "route_id, phase", "cycle", "volume", stl.SEASON_WEEKS, 1),
    "cycles": """SELECT c.route_id, a * 168 + phase AS x, line AS fit,
                        avg(line) OVER (PARTITION BY c.route_id ORDER BY a * 168 + phase
                                        RANGE BETWEEN 84 PRECEDING AND 83 FOLLOWING) AS level
                 FROM cycle_lines c JOIN (SELECT route_id, min(cycle) AS f, max(cycle) AS l FROM series GROUP BY 1) e
                      ON e.route_id = c.route_id AND a BETWEEN f - 1 AND l + 1""",
    "low_lines": lines_sql("cycles", "route_id", "x", "level", stl.WEEK, 24),
    "low": smooth_sql("cycles", "low_lines", 24, "low"),
    "adjusted": """SELECT s.*, fit - low AS season, volume - (fit - low) AS rest
                   FROM series s JOIN low l ON l.route_id = s.route_id AND l.x = s.x""",
    "trend_lines": lines_sql("adjusted", "route_id", "x", "rest", stl.TREND_HOURS, stl.TREND_STEP),
    "parted": smooth_sql("adjusted", "trend_lines", stl.TREND_STEP, "trend"),
}


@query(
    "stl_pass",
    with_tables(
        "demand",
        """SELECT route_id, hour, volume, round(season, 6) AS season, round(trend, 6) AS trend,
                  round(volume - season - trend, 6) AS remainder FROM parted""",
        STL,
    ),
)
def stl_pass(spark, folder):
    """Season and trend of the demand after one turn, from no trend and equal weights."""
    return stl.stl(src.demand(spark, folder), inner=1, outer=0).drop("weight")


@query(
    "stl_forecast_loss",
    with_tables(
        "demand",
        """SELECT round(avg(abs(v.volume - (a + b * (last_x + k) + coalesce(day_mean, 0) + coalesce(residual, 0)))), 6)
                      AS baseline_loss, count(*) AS hours, true AS lower
           FROM (SELECT d.* FROM demand_all d, cut WHERE d.hour > c) v
                JOIN ahead p ON p.route_id = v.route_id AND p.hour = v.hour
                LEFT JOIN daily d ON d.route_id = p.route_id AND hod = hour(p.hour)
                LEFT JOIN weekly w ON w.route_id = p.route_id AND how = (isodow(p.hour) - 1) * 24 + hour(p.hour)""",
        {
            **CUT,
            "demand_all": "SELECT * FROM demand",
            "past": "SELECT demand.* FROM demand, cut WHERE hour < c",
            **{n: t.replace("FROM demand", "FROM past") for n, t in SEASONAL.items()},
        },
    ),
)
def stl_forecast_loss(spark, folder):
    """Mean absolute error of the profile baseline on the week after the split, and whether the decomposition's is lower."""
    train, valid = (materialise(part) for part in split_demand(spark, folder))

    def loss(forecasts, name):
        both = valid.join(forecasts, ["route_id", "hour"])
        return both.agg(F.avg(F.abs(F.col("volume") - F.col("forecast"))).alias(name), F.count(F.lit(1)).alias("hours"))

    base, own = loss(seasonal_forecast(train), "baseline_loss"), loss(stl.stl_forecast(stl.stl(train)), "loss")
    return base.join(own, "hours", "left").select("baseline_loss", "hours", (F.col("loss") < F.col("baseline_loss")).alias("lower"))


GAPS = """SELECT *, lag(hour) OVER (PARTITION BY zone_id ORDER BY hour) AS before FROM (SELECT DISTINCT zone_id, hour FROM seen)"""
SEEN = "SELECT user_id % 700 AS zone_id, date_trunc('hour', ts) AS hour FROM events"


def sightings(spark, folder):
    """Events as sightings of 700 keys, too few for every hour."""
    return src.table(spark, folder, "events").select(F.pmod("user_id", F.lit(700)).alias("zone_id"), "ts")


@query(
    "gap_ranges",
    with_tables(
        "",
        """SELECT zone_id, before + INTERVAL 1 HOUR AS start, hour - INTERVAL 1 HOUR AS "end",
                  date_diff('hour', before, hour) - 1 AS hours
           FROM gaps WHERE date_diff('hour', before, hour) > 1""",
        {"seen": SEEN, "gaps": GAPS},
    ),
)
def missing_ranges(spark, folder):
    return gap_ranges(sightings(spark, folder), "zone_id", ts="ts")


@query(
    "gap_days",
    with_tables(
        "",
        """SELECT DISTINCT CAST(unnest(generate_series(date_trunc('day', before + INTERVAL 1 HOUR),
                                                       hour - INTERVAL 1 HOUR, INTERVAL 1 DAY)) AS DATE) AS day
           FROM gaps WHERE date_diff('hour', before, hour) > 6""",
        {
            "span": """SELECT date_trunc('day', min(o_orderdate)) AS a, date_trunc('day', max(o_orderdate)) + INTERVAL 23 HOUR AS b
                       FROM orders""",
            "seen": """SELECT 0 AS zone_id, o_orderdate AS hour FROM orders WHERE o_orderstatus = 'F'
                       UNION ALL SELECT 0, a - INTERVAL 1 HOUR FROM span UNION ALL SELECT 0, b + INTERVAL 1 HOUR FROM span""",
            "gaps": GAPS,
        },
    ),
)
def days_with_gaps(spark, folder):
    """Days of the order span that lack six hours or more on end of closed orders."""
    orders = src.table(spark, folder, "orders").withColumn("hour", F.col("o_orderdate").cast("timestamp_ntz"))
    day = F.date_trunc("day", "hour").cast("timestamp_ntz")
    span = orders.agg(F.min(day).alias("start"), (F.max(day) + F.expr("interval 23 hours")).alias("end"))
    closed = orders.filter("o_orderstatus = 'F'").withColumn("_all", F.lit(0))
    return gap_days(gap_ranges(closed, "_all", span), 6)


GAP_SUMS = """
    SELECT metric, CAST(hour AS DATE) AS day, sum(CASE WHEN volume >= a THEN q * (volume - a) ELSE (q - 1) * (volume - a) END
                                                 - CASE WHEN volume >= b THEN q * (volume - b) ELSE (q - 1) * (volume - b) END) AS difference,
           count(*) AS n
    FROM (%s) GROUP BY 1, 2""" % " UNION ALL ".join(
    f"""SELECT '{n}' AS metric, x.hour, x.volume, x.{n} AS a, y.{n} AS b, {q} AS q
        FROM day x JOIN week y ON x.route_id = y.route_id AND x.hour = y.hour""" for n, q in val.QUANTILES.items())
U = "CAST('0x' || substr(md5('0|' || strftime(day, '%Y-%m-%d') || '|' || r), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "loss_difference",
    with_tables(
        "demand",
        """SELECT metric, days, "rows", round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS real
           FROM (SELECT metric, count(*) AS days, CAST(sum(n) AS BIGINT) AS "rows", sum(difference) / sum(n) AS mean FROM daily GROUP BY 1)
                JOIN (SELECT metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high
                      FROM (SELECT metric, r, sum(t * difference) / sum(t * n) AS m FROM drawn GROUP BY 1, 2 HAVING sum(t) > 0) GROUP BY 1)
                USING (metric)""",
        {
            "day": naive_sql(24),
            "week": naive_sql(168),
            "daily": GAP_SUMS,
            "drawn": f"""SELECT *, {" + ".join(f"CAST(u >= {p} AS INTEGER)" for p in bootstrap.POISSON)} AS t
                         FROM (SELECT *, {U} AS u FROM daily, range(1, {bootstrap.REPLICATES + 1}) s(r))""",
        },
    ),
)
def loss_difference(spark, folder):
    """Loss of the same hour a day ago less that of a week ago, with its interval over drawn days."""
    demand = src.demand(spark, folder)
    return bootstrap.loss_difference(naive_forecast(demand, 24), naive_forecast(demand, 168))


LEVELS = [0.1, 0.5, 0.9]


@query(
    "sketched_quantiles",
    """WITH span AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events),
            part AS (SELECT * FROM events, span WHERE CAST(ts AS DATE) > a AND CAST(ts AS DATE) < b)
       SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, true AS in_bounds, true AS distinct_in_bounds
       FROM part GROUP BY 1""",
)
def sketched_quantiles(spark, folder):
    """All days but the first and last from stored sketches; whether the true ranks and distinct users are within the errors."""
    path, events = scratch_path(spark, "sketches"), src.table(spark, folder, "events")
    sketches.write_sketches(sketches.daily_sketches(events, ["event_type"], "ts", "value", "user_id"), path)
    day = F.col("ts").cast("date")
    first, last = events.agg(F.date_add(F.min(day), 1).cast("string"), F.date_sub(F.max(day), 1).cast("string")).first()
    found = sketches.estimates(sketches.read_sketches(spark, path, first, last), ["event_type"], LEVELS)
    rows = events.filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).join(small_side(found), "event_type")
    # equal values share a range of ranks; the level has to lie in it, give or take the error
    error = 2 * sketches.RANK_ERROR
    ranks = [
        (F.avg((F.col("value") < F.col("quantiles")[i]).cast("double")) <= q + error)
        & (F.avg((F.col("value") <= F.col("quantiles")[i]).cast("double")) >= q - error)
        for i, q in enumerate(LEVELS)
    ]
    off = F.abs(F.col("distinct") / F.count_distinct("user_id") - 1) <= sketches.DISTINCT_ERROR
    return rows.groupBy("event_type", "n", "least", "most", "distinct").agg(
        (ranks[0] & ranks[1] & ranks[2]).alias("in_bounds"), off.alias("distinct_in_bounds")
    ).drop("distinct")
