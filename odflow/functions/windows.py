"""Row-based window features over an hourly series per key.

Every window here is partitioned by a series key (route or zone) *after* the
raw records were aggregated to one row per key and hour. A partition is thus
bounded by the number of hours in the calendar span (17,520 rows for two
years), however many raw records fall on the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


def series(key: str, order: str = "hour") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def full_mean(value: str, rows: int, w: WindowSpec) -> Column:
    """Mean of the previous ``rows`` values, null until all of them exist."""
    frame = w.rowsBetween(-rows, -1)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def is_integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def running_totals(df: DataFrame, value: str, w: WindowSpec) -> DataFrame:
    """Running sum and running count of ``value`` as ``_sum`` and ``_n``."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"_sum": F.sum(value).over(upto), "_n": F.count(value).over(upto)})


def full_mean_from_totals(rows: int, w: WindowSpec) -> Column:
    """:func:`full_mean` as a difference of two running totals.

    Constant work per row whatever the window length; exact, as the totals are
    whole numbers.
    """
    count = F.lag("_n", 1).over(w) - F.coalesce(F.lag("_n", rows + 1).over(w), F.lit(0))
    total = F.lag("_sum", 1).over(w) - F.coalesce(F.lag("_sum", rows + 1).over(w), F.lit(0))
    return F.when(count == rows, total / F.lit(rows))


def add_trailing(
    df: DataFrame,
    key: str,
    value: str,
    rows: int,
    mean: str,
    spread: str | None = None,
    order: str = "hour",
) -> DataFrame:
    """Mean (and sample deviation) of the previous ``rows`` values, null until all exist.

    The series is cut into blocks of ``rows`` rows, so that a trailing window is
    the end of one block and the start of the next. Both parts come from running
    aggregates, once forwards and once backwards, and are combined by their
    counts, means and variances. Linear in rows whatever the window length, and
    without the cancellation of differences of running sums.
    """
    place, block = F.col("_place"), "_part"
    numbered = df.withColumn("_place", F.row_number().over(series(key, order)) - 1).withColumn(
        block, (place / rows).cast("int")
    )
    for name, by in (("_head", F.asc(order)), ("_tail", F.desc(order))):
        w = Window.partitionBy(key, block).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        parts = [F.count(value).over(w).alias("n"), F.avg(value).over(w).alias("mean")]
        if spread:
            parts.append(F.var_pop(value).over(w).alias("var"))
        numbered = numbered.withColumn(name, F.struct(*parts))
    w = Window.partitionBy(key).orderBy(block, order)
    both = numbered.withColumns(
        {
            "_head": F.when(place % rows > 0, F.lag("_head", 1).over(w)),
            "_tail": F.lag("_tail", rows).over(w),
        }
    )

    def get(part: str, name: str) -> Column:
        return F.coalesce(F.col(f"{part}.{name}"), F.lit(0))

    a, b = get("_head", "n"), get("_tail", "n")
    step = get("_head", "mean") - get("_tail", "mean")
    full = a + b == rows
    out = {mean: F.when(full, get("_tail", "mean") + step * a / rows)}
    if spread:
        squares = a * get("_head", "var") + b * get("_tail", "var") + step * step * a * b / rows
        out[spread] = F.when(full, F.sqrt(squares / (rows - 1)))
    return both.withColumns(out).drop("_place", block, "_head", "_tail")


def ewm_block(span: int) -> tuple[float, int]:
    """Decay factor and the block length after which a value has no weight left.

    ``decay ** rows`` is below 1e-18 of the whole, under a double's resolution,
    while ``decay ** -rows`` stays far from overflow.
    """
    decay = 1.0 - 2.0 / (span + 1.0)
    return decay, math.ceil(18.0 * math.log(10.0) / -math.log(decay))


def add_block(df: DataFrame, key: str, span: int, order: str = "hour") -> DataFrame:
    """Number the rows of each series and cut it into blocks: ``_row``, ``_block``."""
    _, rows = ewm_block(span)
    numbered = df.withColumn("_row", F.row_number().over(series(key, order)) - 1)
    return numbered.withColumn("_block", (F.col("_row") / rows).cast("int"))


def add_ewm(
    df: DataFrame, key: str, value: str, span: int, out: str, order: str = "hour"
) -> DataFrame:
    """Recursive exponentially weighted mean up to and including each row.

    ``e[0] = v[0]`` and ``e[t] = a*v[t] + (1-a)*e[t-1]`` with ``a = 2/(span+1)``.
    Needs :func:`add_block`. Inside a block the recursion is a scaled running
    sum; a block then only needs the value at the end of the block before it,
    because anything older weighs less than a double can hold. Linear in rows,
    no arrays, and the block windows reuse the exchange of ``key``.
    """
    decay, rows = ewm_block(span)
    alpha = 1.0 - decay
    position = F.col("_row") % rows
    scaled = (
        F.col(value).cast("double")
        * F.when(F.col("_row") == 0, F.lit(1.0 / alpha)).otherwise(F.lit(1.0))
        * F.pow(F.lit(decay), -position)
    )
    in_block = Window.partitionBy(key, "_block").orderBy(order)
    local = (
        F.lit(alpha)
        * F.pow(F.lit(decay), position)
        * F.sum(scaled).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    )
    by_block = Window.partitionBy(key).orderBy("_block", order)
    block_end = F.last(F.when(position == rows - 1, F.col("_local")), ignorenulls=True)
    carry = block_end.over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    return (
        df.withColumn("_local", local)
        .withColumn("_carry", carry)
        .withColumn(
            out,
            F.col("_local")
            + F.when(
                F.col("_block") > 0, F.pow(F.lit(decay), position + 1) * F.col("_carry")
            ).otherwise(F.lit(0.0)),
        )
        .drop("_local", "_carry")
    )


def ordered_index(df: DataFrame, coarse: str, fine: list[str], out: str) -> DataFrame:
    """0-based position of each row in the order of ``coarse`` then ``fine``.

    Only the table of distinct ``coarse`` values is ordered as a whole; the rows
    themselves are numbered inside their own ``coarse`` group. Both are small by
    construction when ``coarse`` is an hour or a day of an hourly table.
    """
    sizes = df.groupBy(coarse).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(coarse, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(coarse).orderBy(*fine)
    return (
        df.join(starts, coarse)
        .withColumn(out, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_start")
    )
