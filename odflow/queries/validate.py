"""Splits, folds, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.functions.scalars import zero_fill
from odflow.functions.windows import series
from odflow.operators import conformal
from odflow.operators import validation as val
from odflow.operators.forest import QuantileForest, leaf_quantiles
from odflow.operators.profile import QuantileProfile
from odflow.operators.seasonal import seasonal_forecast
from odflow.plans.training import ablation, train_boost, train_forest
from odflow.queries.base import query, sql_flag, sql_lag, with_tables
from odflow.queries.features import features
from odflow.session import materialise, scratch_path, small_side
from odflow.sources import driver_tables as src

INDEXED = "SELECT *, dense_rank() OVER (ORDER BY hour) - 1 AS time_idx FROM demand"


@query(
    "time_index",
    with_tables("demand", f"SELECT DISTINCT hour, CAST(time_idx AS INTEGER) AS time_idx FROM ({INDEXED})"),
)
def time_index(spark, folder):
    return val.hour_index(src.demand(spark, folder))


CUT = {
    "idx": INDEXED,
    "n": "SELECT max(time_idx) + 1 AS n FROM idx",
    "cut": "SELECT DISTINCT hour AS c FROM idx, n WHERE time_idx = least(greatest(1, floor(n * 0.8)), n - 1)",
}


def split_demand(spark, folder):
    return val.time_split(src.demand(spark, folder), features=["route_id", "volume"])


@query(
    "time_split",
    with_tables(
        "demand",
        """SELECT route_id, hour, volume, CASE WHEN hour < c THEN 'train' ELSE 'valid' END AS side
           FROM demand, cut WHERE hour <> c""",
        CUT,
    ),
)
def time_split(spark, folder):
    train, valid = split_demand(spark, folder)
    both = train.withColumn("side", F.lit("train")).union(valid.withColumn("side", F.lit("valid")))
    return both.select("route_id", "hour", "volume", "side")


@query(
    "dense_time_index",
    with_tables(
        "demand",
        """SELECT route_id, d.hour, CAST(time_idx - CASE WHEN d.hour > c THEN 1 ELSE 0 END AS INTEGER) AS time_idx,
                  CASE WHEN d.hour < c THEN 'train' ELSE 'valid' END AS side
           FROM idx d, cut WHERE d.hour <> c""",
        CUT,
    ),
)
def dense_time_index(spark, folder):
    """Training hours count from 0, validation hours go on behind them."""
    train, valid = val.dense_time_index(*split_demand(spark, folder))
    both = train.withColumn("side", F.lit("train")).union(valid.withColumn("side", F.lit("valid")))
    return both.select("route_id", "hour", "time_idx", "side")


ROWS = {
    "numbered": "SELECT *, row_number() OVER (ORDER BY hour, route_id) - 1 AS row_idx FROM demand",
    "folds": """SELECT CAST(f AS INTEGER) AS fold, n - (5 - f) * (n // 6) AS start, n // 6 AS size
                FROM range(0, 5) t(f), (SELECT count(*) AS n FROM demand)""",
    "roles": """SELECT m.*, fold, CASE WHEN row_idx < start - 24 THEN 'train'
                                       WHEN row_idx >= start AND row_idx < start + size THEN 'test' END AS role
                FROM numbered m, folds""",
}


@query(
    "walk_forward_folds",
    with_tables(
        "demand", "SELECT route_id, hour, fold, role FROM roles WHERE role IS NOT NULL", ROWS
    ),
)
def walk_forward_folds(spark, folder):
    folds = val.walk_forward(src.demand(spark, folder), folds=5, gap=24)
    return folds.select("route_id", "hour", "fold", "role")


@query("row_index", with_tables("demand", "SELECT route_id, hour, row_idx FROM numbered", {"numbered": ROWS["numbered"]}))
def row_index(spark, folder):
    """Position of each row in the order of hour and route."""
    return val.row_index(src.demand(spark, folder)).select("route_id", "hour", "row_idx")


@query(
    "walk_forward_hours",
    with_tables(
        "demand",
        """, r AS (SELECT route_id, hour, CAST(f AS INTEGER) AS fold,
                   CASE WHEN time_idx < n - (5 - f) * (n // 6) - 24 THEN 'train'
                        WHEN time_idx >= n - (5 - f) * (n // 6)
                             AND time_idx < n - (5 - f) * (n // 6) + n // 6 THEN 'test' END AS role
                   FROM idx, n, range(0, 5) t(f))
           SELECT route_id, hour, fold, role FROM r WHERE role IS NOT NULL""",
        {"idx": INDEXED, "n": "SELECT max(time_idx) + 1 AS n FROM idx"},
    ),
)
def walk_forward_hours(spark, folder):
    """The split counted in hours instead of rows."""
    folds = val.walk_forward_hours(src.demand(spark, folder), folds=5, gap=24)
    return folds.select("route_id", "hour", "fold", "role")


def naive_forecast(demand, rows: int):
    """The value ``rows`` rows back as median, half and one and a half of it as limits."""
    base = F.lag("volume", rows).over(series("route_id"))
    return (
        demand.withColumn("p50", base.cast("double"))
        .withColumns({"p10": F.col("p50") * 0.5, "p90": F.col("p50") * 1.5})
        .filter(F.col("p50").isNotNull())
    )


NAIVE = """SELECT *, 0.5 * p50 AS p10, 1.5 * p50 AS p90 FROM (
               SELECT *, CAST(%s AS DOUBLE) AS p50 FROM demand) WHERE p50 IS NOT NULL"""


def naive_sql(rows: int) -> str:
    return NAIVE % sql_lag("volume", rows)


def loss_sql(name: str, q: float) -> str:
    return f"avg(CASE WHEN volume >= {name} THEN {q} * (volume - {name}) ELSE ({q} - 1) * (volume - {name}) END)"


LOSSES = {"p10": loss_sql("p10", 0.1), "p50": loss_sql("p50", 0.5), "p90": loss_sql("p90", 0.9),
          "coverage_80pct": "avg(CASE WHEN volume BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END)"}
LOSS_LIST = ", ".join(f"round({e}, 6) AS {n}" for n, e in LOSSES.items())


@query(
    "pinball_and_coverage",
    with_tables("demand", f"SELECT route_id, {LOSS_LIST} FROM naive GROUP BY 1", {"naive": naive_sql(24)}),
)
def pinball_and_coverage(spark, folder):
    return val.quantile_metrics(naive_forecast(src.demand(spark, folder), 24), ["route_id"])


@query(
    "point_errors",
    with_tables(
        "demand",
        """SELECT route_id, round(avg(abs(p50 - volume)), 6) AS mae,
                  round(sqrt(avg((p50 - volume) * (p50 - volume))), 6) AS rmse FROM naive GROUP BY 1""",
        {"naive": naive_sql(24)},
    ),
)
def point_errors(spark, folder):
    return val.point_metrics(naive_forecast(src.demand(spark, folder), 24), ["route_id"])


@query(
    "calibration",
    with_tables(
        "demand",
        " UNION ALL ".join(
            f"SELECT CAST({q} AS DOUBLE) AS nominal, round(avg(CASE WHEN volume <= {n} THEN 1.0 ELSE 0.0 END), 6) AS observed FROM naive"
            for n, q in val.QUANTILES.items()
        ),
        {"naive": naive_sql(24)},
    ),
)
def calibration(spark, folder):
    return val.calibration(naive_forecast(src.demand(spark, folder), 24))


DAYS_AHEAD = "CAST(least(date_diff('hour', {first}, {hour}) // 24 + 1, 7) AS INTEGER)"
SCORES = {
    **CUT,
    "naive": naive_sql(24),
    "tested": """SELECT p.*, f FROM naive p JOIN idx USING (route_id, hour), n, range(0, 5) t(f)
                 WHERE hour < (SELECT c FROM cut) AND idx.time_idx >= past - (5 - f) * (past // 6)
                       AND idx.time_idx < past - (5 - f) * (past // 6) + past // 6""",
    "began": "SELECT f, min(idx.hour) AS first FROM idx, n, range(0, 5) t(f) WHERE time_idx >= past - (5 - f) * (past // 6) GROUP BY f",
    "scored": f"""SELECT {DAYS_AHEAD.format(first="first", hour="hour")} AS horizon,
                         greatest(p10 - volume, volume - p90) AS score FROM tested JOIN began USING (f)""",
    "ranked": """SELECT horizon, score, count(*) OVER (PARTITION BY horizon) AS n,
                        row_number() OVER (PARTITION BY horizon ORDER BY score) AS r
                 FROM (SELECT * FROM scored UNION ALL SELECT 0, score FROM scored)""",
    "margins": """SELECT horizon, n, max(CASE WHEN r = ceil(round((n + 1) * 0.8, 9)) THEN score END) AS margin
                  FROM ranked GROUP BY horizon, n""",
    "widened": f"""SELECT p.route_id, p.hour, p.volume, p.p50, p.p10 AS raw10, p.p90 AS raw90, h AS horizon,
                          least(p50, greatest(0.0, least(p50, p10 - m))) AS p10, greatest(p50, p90 + m) AS p90
                   FROM (SELECT *, {DAYS_AHEAD.format(first="(SELECT min(hour) FROM naive, cut WHERE hour > c)", hour="hour")} AS h
                         FROM naive, cut WHERE hour > c) p
                        LEFT JOIN (SELECT h0 AS h, coalesce(own.margin, whole.margin, 0.0) AS m
                                   FROM range(1, 8) t(h0) LEFT JOIN margins own ON own.horizon = h0
                                        LEFT JOIN margins whole ON whole.horizon = 0) USING (h)""",
}
# hours before the boundary hour
SCORES["n"] = "SELECT max(time_idx) + 1 AS n, floor((max(time_idx) + 1) * 0.8) AS past FROM idx"


def naive_margins(spark, folder):
    """Margins of the same hour a day ago from the walk-forward test hours before the boundary hour."""
    demand = src.demand(spark, folder)
    train, valid = split_demand(spark, folder)
    tests = val.walk_forward_hours(train, 5, 24).filter("role = 'test'").select("route_id", "hour", "fold")
    began = small_side(tests.groupBy("fold").agg(F.min("hour").alias("first")))
    held_out = naive_forecast(demand, 24).join(tests, ["route_id", "hour"]).join(began, "fold")
    held_out = held_out.withColumn("horizon", conformal.days_ahead(F.col("hour"), F.col("first")))
    found = materialise(conformal.margins(conformal.scores(held_out)), "margins")
    later = naive_forecast(demand, 24).join(valid.select("route_id", "hour"), ["route_id", "hour"], "left_semi")
    first = later.agg(F.min("hour")).scalar()
    return found, later.withColumn("horizon", conformal.days_ahead(F.col("hour"), first))


@query("conformal_margins", with_tables("demand", "SELECT horizon, n, round(margin, 6) AS margin FROM margins", SCORES))
def conformal_margins(spark, folder):
    return naive_margins(spark, folder)[0]


@query(
    "conformal_intervals",
    with_tables(
        "demand", "SELECT route_id, hour, horizon, round(p10, 6) AS p10, p50, round(p90, 6) AS p90 FROM widened", SCORES
    ),
)
def conformal_intervals(spark, folder):
    """The intervals of the validation hours, moved by the margin of their day ahead."""
    found, later = naive_margins(spark, folder)
    return conformal.calibrate(later, found).select("route_id", "hour", "horizon", "p10", "p50", "p90")


@query(
    "conformal_coverage",
    with_tables(
        "demand",
        """SELECT horizon, count(*) AS n, round(avg(CASE WHEN volume BETWEEN raw10 AND raw90 THEN 1.0 ELSE 0.0 END), 6) AS before,
                  round(avg(CASE WHEN volume BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 6) AS after
           FROM widened GROUP BY 1""",
        SCORES,
    ),
)
def conformal_coverage(spark, folder):
    """Share of the validation observations inside the interval, before and after."""
    found, later = naive_margins(spark, folder)
    raw = later.withColumns({"_low": F.col("p10"), "_high": F.col("p90")})
    done = conformal.calibrate(raw, found)
    return done.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(val.interval_coverage(F.col("volume"), F.col("_low"), F.col("_high"))).alias("before"),
        F.avg(val.interval_coverage(F.col("volume"), F.col("p10"), F.col("p90"))).alias("after"),
    )


def fold_sql() -> str:
    parts = []
    for model, rows in (("day", 24), ("week", 168)):
        for name, loss in LOSSES.items():
            parts.append(
                f"""SELECT '{model}' AS model, '{name}' AS metric, round(avg(v), 6) AS mean_value
                    FROM (SELECT fold, {loss} AS v FROM (
                        SELECT r.fold, p.* FROM ({naive_sql(rows)}) p
                        JOIN roles r ON r.route_id = p.route_id AND r.hour = p.hour WHERE role = 'test')
                        GROUP BY fold)"""
            )
    return " UNION ALL ".join(parts)


@query("fold_means", with_tables("demand", fold_sql(), ROWS))
def fold_means(spark, folder):
    """Fold means of two naive forecasts over the walk-forward test rows."""
    demand = src.demand(spark, folder)
    tests = val.walk_forward(demand, 5, 24).filter("role = 'test'").select("route_id", "hour", "fold")
    parts = [
        val.quantile_metrics(naive_forecast(demand, rows).join(tests, ["route_id", "hour"]), ["fold"]).withColumn(
            "model", F.lit(model)
        )
        for model, rows in (("day", 24), ("week", 168))
    ]
    return val.fold_means(parts[0].union(parts[1]), list(LOSSES))


@query(
    "prediction_parity",
    with_tables(
        "demand",
        """SELECT 'p50' AS "column", round(max(abs(a.p50 - b.p50)), 6) AS max_abs_diff,
                  max(abs(a.p50 - b.p50)) <= 0.001 AS ok
           FROM day a JOIN week b ON a.route_id = b.route_id AND a.hour = b.hour""",
        {"day": naive_sql(24), "week": naive_sql(168)},
    ),
)
def prediction_parity(spark, folder):
    """Largest difference between two prediction sets."""
    demand = src.demand(spark, folder)
    gaps = val.max_difference(
        naive_forecast(demand, 24), naive_forecast(demand, 168), ["route_id", "hour"], ["p50"]
    )
    return val.within(gaps)


SEASONAL = {
    "t": f"""SELECT *, CASE WHEN count(volume) OVER w = 168 THEN avg(volume) OVER w END AS trend,
                    date_diff('hour', min(hour) OVER (PARTITION BY route_id), hour) AS x
             FROM demand
             WINDOW w AS (PARTITION BY route_id ORDER BY hour ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)""",
    "u": "SELECT *, volume - trend AS de, (isodow(hour) - 1) * 24 + hour(hour) AS how FROM t",
    "daily": "SELECT route_id, hour(hour) AS hod, avg(de) AS day_mean FROM u GROUP BY 1, 2",
    "weekly": """SELECT u.route_id, how, avg(de - day_mean) AS residual
                 FROM u JOIN daily d ON d.route_id = u.route_id AND hod = hour(hour) GROUP BY 1, 2""",
    "lines": """SELECT route_id, regr_slope(trend, x) AS b, regr_intercept(trend, x) AS a,
                       max(hour) AS last_hour, max(x) AS last_x FROM u GROUP BY 1""",
    "ahead": """SELECT *, last_hour + to_hours(CAST(k AS INTEGER)) AS hour FROM lines, range(1, 169) s(k)""",
}


@query(
    "seasonal_baseline",
    with_tables(
        "demand",
        """SELECT p.route_id, p.hour,
                  round(a + b * (last_x + k) + coalesce(day_mean, 0) + coalesce(residual, 0), 6) AS forecast
           FROM ahead p LEFT JOIN daily d ON d.route_id = p.route_id AND hod = hour(p.hour)
                LEFT JOIN weekly w ON w.route_id = p.route_id
                     AND how = (isodow(p.hour) - 1) * 24 + hour(p.hour)""",
        SEASONAL,
    ),
)
def seasonal_baseline(spark, folder):
    return seasonal_forecast(src.demand(spark, folder), 168)


def training_data(spark, folder):
    """Filled feature table, materialised once, split by time."""
    return val.time_split(materialise(zero_fill(features(spark, folder))))


@query(
    "leaf_quantiles",
    """SELECT CAST(l_linenumber AS INTEGER) AS tree, l_suppkey % 16 AS leaf, """
    + ", ".join(f"round(quantile_cont(l_quantity, {q}), 6) AS {n}" for n, q in val.QUANTILES.items())
    + " FROM lineitem GROUP BY 1, 2",
)
def grouped_quantiles(spark, folder):
    """Quantiles of the line quantities in the leaves of a made-up partition into trees."""
    rows = src.table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("tree"), F.pmod("l_suppkey", F.lit(16)).alias("leaf"), "l_quantity"
    )
    return leaf_quantiles(rows, "l_quantity")


def forecast_checks(train):
    """What SQL can state of a model's forecasts: levels in order, inside the range of the training target."""
    low, high = train.agg(F.min("volume")).scalar(), train.agg(F.max("volume")).scalar()
    return {
        "ordered": (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90")),
        "in_range": (F.col("p10") >= low) & (F.col("p90") <= high),
    }


@query(
    "quantile_forest",
    with_tables(
        "demand",
        """SELECT route_id, hour, CAST(volume AS DOUBLE) AS volume, true AS ordered, true AS in_range
           FROM demand, cut WHERE hour > c""",
        CUT,
    ),
)
def quantile_forest(spark, folder):
    """Forecasts of the validation hours, with their order and range checked."""
    train, valid = training_data(spark, folder)
    forecasts = train_forest(train).predict(valid).withColumns(forecast_checks(train))
    return forecasts.select("route_id", "hour", F.col("volume").cast("double").alias("volume"), "ordered", "in_range")


def against_day(demand, valid, forecasts):
    """Losses of the same hour a day ago on the hours of ``valid``, and whether those of ``forecasts`` are lower."""
    day = naive_forecast(demand, 24).join(valid.select("route_id", "hour"), ["route_id", "hour"], "left_semi")
    parts = [
        val.quantile_metrics(df.withColumn("one", F.lit(1)), ["one"]).select(
            "one", F.stack(F.lit(3), *[x for n in val.QUANTILES for x in (F.lit(n), F.col(n))]).alias("metric", name)
        )
        for name, df in (("day_loss", day), ("loss", forecasts))
    ]
    both = parts[0].join(parts[1].drop("one"), "metric")
    return both.select("metric", "day_loss", (F.col("loss") < F.col("day_loss")).alias("better"))


@query(
    "forest_metrics",
    with_tables(
        "demand",
        " UNION ALL ".join(
            f"SELECT '{n}' AS metric, round({LOSSES[n]}, 6) AS day_loss, true AS better FROM naive, cut WHERE hour > c"
            for n in val.QUANTILES
        ),
        {**CUT, "naive": naive_sql(24)},
    ),
)
def forest_metrics(spark, folder):
    """Pinball losses of the same hour a day ago on the validation hours, and whether the forest's are lower."""
    train, valid = training_data(spark, folder)
    return against_day(src.demand(spark, folder), valid, train_forest(train).predict(valid))


@query(
    "boost_metrics",
    with_tables(
        "demand",
        " UNION ALL ".join(
            f"SELECT '{n}' AS metric, round({LOSSES[n]}, 6) AS day_loss, true AS better FROM naive, cut WHERE hour > c"
            for n in val.QUANTILES
        ),
        {**CUT, "naive": naive_sql(24)},
    ),
)
def boost_metrics(spark, folder):
    """As forest_metrics, for trees grown on the loss of each level; the training hours' end decides when to stop."""
    train, valid = training_data(spark, folder)
    learn, watch = val.time_split(train)
    model = train_boost(learn, watch)
    return against_day(src.demand(spark, folder), valid, model.predict(valid))


@query(
    "covariate_ablation",
    f"""SELECT model, metric, true AS plausible FROM (VALUES ('full'), ('no_congestion')) a(model),
        (VALUES {", ".join(f"('{n}')" for n in LOSSES)}) b(metric)""",
)
def covariate_ablation(spark, folder):
    """Cross-validated losses with and without the congestion features: between 0 and the mean target, shares up to 1."""
    train, _ = training_data(spark, folder)
    limit = F.when(F.col("metric") == "coverage_80pct", 1.0).otherwise(train.agg(F.avg("volume")).scalar())
    return ablation(train, folds=3).select(
        "model", "metric", F.col("mean_value").between(F.lit(0.0), limit).alias("plausible")
    )


def profile_sql(model: str, cells: str) -> str:
    """Fold means of the quantile profile over ``cells``."""
    levels = ", ".join(f"quantile_cont(volume, {q}) AS {n}" for n, q in val.QUANTILES.items())
    found = ", ".join(f"coalesce(c.{n}, a.{n}) AS {n}" for n in val.QUANTILES)
    return f"""
        SELECT '{model}' AS model, metric, round(avg(v), 6) AS mean_value FROM (
            UNPIVOT (SELECT fold, {LOSS_LIST.replace("round(", "(").replace(", 6) AS", ") AS")} FROM (
                SELECT t.fold, t.volume, {found} FROM parts t
                LEFT JOIN (SELECT fold, {cells}, {levels} FROM parts WHERE role = 'train' GROUP BY fold, {cells}) c USING (fold, {cells})
                JOIN (SELECT fold, {levels} FROM parts WHERE role = 'train' GROUP BY fold) a USING (fold)
                WHERE role = 'test') GROUP BY fold) ON {", ".join(LOSSES)} INTO NAME metric VALUE v)
        GROUP BY metric"""


@query(
    "ablation_metrics",
    with_tables(
        "demand routes congestion",
        profile_sql("full", "hod, flag") + " UNION ALL " + profile_sql("no_congestion", "hod"),
        {
            **CUT,
            "signal": f"SELECT zone_id, hour, {sql_flag()} AS flag FROM congestion",
            "lines": """SELECT d.route_id, d.hour, CAST(volume AS DOUBLE) AS volume, hour(d.hour) AS hod,
                               coalesce(flag, 0) AS flag, row_number() OVER (ORDER BY d.hour, d.route_id) - 1 AS i
                        FROM demand d JOIN routes r ON r.route_id = d.route_id
                             LEFT JOIN signal s ON s.zone_id = origin_zone_id AND s.hour = d.hour, cut WHERE d.hour < c""",
            "parts": """SELECT l.*, f AS fold, CASE WHEN i < n - (3 - f) * (n // 4) - 24 THEN 'train'
                               WHEN i >= n - (3 - f) * (n // 4) AND i < n - (3 - f) * (n // 4) + n // 4 THEN 'test' END AS role
                        FROM lines l, range(0, 3) t(f), (SELECT count(*) AS n FROM lines)""",
        },
    ),
)
def ablation_metrics(spark, folder):
    """The whole ablation, folds to means, with a model whose forecasts SQL can state: quantiles by hour of day and flag."""
    train, _ = training_data(spark, folder)
    return ablation(train, folds=3, model=QuantileProfile)


@query(
    "model_parity",
    f"""SELECT m AS "column", CAST(0 AS DOUBLE) AS max_abs_diff, true AS ok
        FROM (VALUES {", ".join(f"('{n}')" for n in val.QUANTILES)}) t(m)""",
)
def model_parity(spark, folder):
    """Predictions of a model and of its stored copy."""
    train, valid = training_data(spark, folder)
    model = train_forest(train)
    path = scratch_path(spark, "model")
    model.save(path, spark)
    again = QuantileForest.load(path, spark)
    keys, columns = ["route_id", "hour"], ["p10", "p50", "p90"]
    gaps = val.max_difference(
        model.predict(valid).select(*keys, *columns), again.predict(valid).select(*keys, *columns), keys, columns
    )
    return val.within(gaps)
