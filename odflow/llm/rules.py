"""Quality rules: robust multivariate outliers by the minimum covariance determinant, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.session import materialise, small_side

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Statistics and the least deviation that counts for each, in transformed units.
FLOORS = {"word_length": 0.10, "symbols": 0.25, "dup_lines": 0.75, "repeats": 0.75, "capitals": 0.10}
KEPT_SHARE = 0.75
STEPS = 4
#: Chance that a clean vector of a normal population lies beyond the cut.
TAIL = 1e-9
BINS_PER_UNIT = 32


def text_counts(docs: DataFrame, extra: list[str]) -> DataFrame:
    """doc_id, ``extra``, and counts of words, characters, symbols, repeated lines and repeated words.

    Everything is worked out inside the row. Windows of five words are compared by a 64-bit hash of
    the words; only texts with a repeated window pay for the sort that finds which words it covers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        *extra,
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    n = F.size("_words")
    grams = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id",
        *extra,
        "n_symbols",
        "n_capitals",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("_grams"),
    )
    ordered = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("_ordered", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), ordered).otherwise(none)).drop("_grams")

    def twin(k: Column, x: Column, step: int) -> Column:
        return F.coalesce(F.get("_ordered", k + step)["h"] == x["h"], F.lit(False))

    repeated = F.filter("_ordered", lambda x, k: twin(k, x, -1) | twin(k, x, 1))
    places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["total"] + p + WINDOW - F.greatest(a["end"], p)).alias("total")
        ),
        lambda a: a["total"],
    )
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("_ordered")


def failed_base(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (n_repeat_words * 100 > n_words * 20)


def statistics() -> dict[str, Column]:
    """Transformed statistics of a text with words: logs of ratios, near to symmetric for prose."""
    per_hundred = lambda part, whole: F.log1p(100.0 * F.col(part) / F.col(whole))
    return {
        "word_length": F.log(F.col("word_chars") / F.col("n_words")),
        "symbols": per_hundred("n_symbols", "word_chars"),
        "dup_lines": per_hundred("n_dup_lines", "n_lines"),
        "repeats": per_hundred("n_repeat_words", "n_words"),
        "capitals": F.sqrt(F.col("n_capitals") / F.col("word_chars")),
    }


def chi2_cdf(x: float, dof: int) -> float:
    """Distribution function of chi-squared, by the series of the incomplete gamma function."""
    a, term, total, k = dof / 2, 0.0, 0.0, 0
    term = total = 1 / a
    while term > total * 1e-16:
        k += 1
        term *= (x / 2) / (a + k)
        total += term
    return total * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, dof) < p else (low, middle)
    return low


def consistency(dof: int) -> float:
    """Factor that makes the covariance of the inner share right for a normal population."""
    return KEPT_SHARE / chi2_cdf(chi2_quantile(KEPT_SHARE, dof), dof + 2)


def same_group(keys: list[str]) -> Column:
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return match


def distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance, from the centre and inverse Cholesky factor in the row."""
    total = F.lit(0.0)
    for i in range(len(names)):
        turned = F.lit(0.0)
        for j in range(i + 1):
            turned = turned + F.col(f"_w{i}{j}") * (F.col(names[j]) - F.col(f"_m{j}"))
        total = total + turned * turned
    return total


def with_factor(moments: DataFrame, keys: list[str], names: list[str], factor: float) -> DataFrame:
    """Centre and inverse Cholesky factor of each group, from its count and sums."""
    p = len(names)
    out = moments
    for i in range(p):
        out = out.withColumn(f"_m{i}", F.col(f"_s{i}") / F.col("_n"))
    for i in range(p):
        for j in range(i + 1):
            cov = (F.col(f"_q{i}{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}")) * factor
            # the floor keeps groups whose texts all agree in a statistic from a singular matrix
            out = out.withColumn(f"_c{i}{j}", F.greatest(cov, F.lit(0.0)) + FLOORS[names[i]] ** 2 if i == j else cov)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"_c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            out = out.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"_l{j}{j}"))
    for i in range(p):
        for j in range(i + 1):
            if i == j:
                w = 1 / F.col(f"_l{i}{i}")
            else:
                w = F.lit(0.0)
                for k in range(j, i):
                    w = w - F.col(f"_l{i}{k}") * F.col(f"_w{k}{j}")
                w = w / F.col(f"_l{i}{i}")
            out = out.withColumn(f"_w{i}{j}", w)
    kept = [f"_m{i}" for i in range(p)] + [f"_w{i}{j}" for i in range(p) for j in range(i + 1)]
    return out.select(*[F.col(k).alias(f"_{k}") for k in keys], *kept)


def start(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Medians and median deviations of each group, as a diagonal factor."""
    medians = rows.groupBy(*keys).agg(*[F.percentile_approx(n, 0.5, 1000).alias(f"_m{i}") for i, n in enumerate(names)])
    centred = rows.join(small_side(medians.select(*[F.col(k).alias(f"_{k}") for k in keys], *[f"_m{i}" for i in range(len(names))])), same_group(keys))
    spread = centred.groupBy(*keys).agg(
        *[F.first(f"_m{i}").alias(f"_m{i}") for i in range(len(names))],
        *[F.percentile_approx(F.abs(F.col(n) - F.col(f"_m{i}")), 0.5, 1000).alias(f"_d{i}") for i, n in enumerate(names)],
    )
    out = spread
    for i, n in enumerate(names):
        for j in range(i):
            out = out.withColumn(f"_w{i}{j}", F.lit(0.0))
        out = out.withColumn(f"_w{i}{i}", 1 / F.sqrt((1.4826 * F.col(f"_d{i}")) ** 2 + FLOORS[n] ** 2))
    kept = [f"_m{i}" for i in range(len(names))] + [f"_w{i}{j}" for i in range(len(names)) for j in range(i + 1)]
    return out.select(*[F.col(k).alias(f"_{k}") for k in keys], *kept)


def concentrate(rows: DataFrame, shape: DataFrame, keys: list[str], names: list[str], factor: float) -> DataFrame:
    """One concentration step: moments of the share of each group nearest to its centre.

    Distances fall into narrow bins, and one aggregate gives the count and the sums of each bin; the
    bins up to the wanted share then add up. No group is ordered, whatever its size.
    """
    p = len(names)
    near = rows.join(small_side(shape), same_group(keys)).withColumn(
        "_bin", F.floor(F.log(distance(names) + 1e-6) * BINS_PER_UNIT)
    )
    sums = [F.count("*").alias("_n")]
    sums += [F.sum(names[i]).alias(f"_s{i}") for i in range(p)]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_q{i}{j}") for i in range(p) for j in range(i + 1)]
    bins = near.groupBy(*keys, "_bin").agg(*sums)
    by_group = Window.partitionBy(*keys)
    before = by_group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_all", F.sum("_n").over(by_group)
    ).where(F.col("_before") < F.ceil(F.col("_all") * KEPT_SHARE))
    totals = inner.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in bins.columns if c not in (*keys, "_bin")])
    return with_factor(totals, keys, names, factor)


def outlier_rules(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), steps: int = STEPS, tail: float = TAIL) -> DataFrame:
    """Per document: doc_id, counts, base_failed, distance (squared, null if base_failed) and kept.

    Input: doc_id, text and ``keys``; other columns are ignored. Texts that pass the base rules are
    described by the statistics of :func:`statistics`. For each group of ``keys`` (null is a value like
    any other) centre and covariance come from the 75 % of texts whose covariance has the least
    determinant, found by concentration steps from medians; a text is kept if its squared
    Mahalanobis distance is below the chi-squared quantile of ``1 - tail``. A group of one or of
    equal texts has the floors as its deviations and keeps its texts. Null and empty texts have no
    words and fail the base rules. Repeated rows are judged alike. An empty table gives no rows.
    """
    keys, names = list(keys), list(FLOORS)
    counts = text_counts(docs, keys).withColumn("base_failed", failed_base(F.col("n_words"), F.col("n_repeat_words")))
    stats = statistics()
    rows = materialise(counts.withColumns({n: F.when(~F.col("base_failed"), c) for n, c in stats.items()}), "rules")
    fit = rows.where(~F.col("base_failed")).select(*keys, *names)
    shape = start(fit, keys, names)
    for _ in range(steps):
        shape = materialise(concentrate(fit, shape, keys, names, consistency(len(names))), "shape")
    cut = chi2_quantile(1 - tail, len(names))
    judged = rows.join(small_side(shape), same_group(keys), "left").withColumn(
        "distance", F.when(~F.col("base_failed"), distance(names))
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"),
    )
