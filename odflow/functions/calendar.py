"""Calendar, holiday and event features as plain column expressions.

Holidays are computed from their rules inside the projection, so the calendar
costs no shuffle whatever the table size; only published event dates are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.session import small_side

# Recurring city events as month-day.
CITY_EVENT_DAYS = ["01-01", "03-17", "07-04", "11-01", "12-31"]

# US federal holidays, rules in force since 1978.
# (name, month, day, first year); a Saturday is also observed on the Friday
# before, a Sunday on the Monday after.
FIXED_HOLIDAYS = [
    ("New Year's Day", 1, 1, None),
    ("Juneteenth", 6, 19, 2021),
    ("Independence Day", 7, 4, None),
    ("Veterans Day", 11, 11, None),
    ("Christmas Day", 12, 25, None),
]
# (name, month, weekday, earliest day of the month it can fall on, first year)
FLOATING_HOLIDAYS = [
    ("Martin Luther King Jr. Day", 1, "Mon", 15, 1986),
    ("Washington's Birthday", 2, "Mon", 15, None),
    ("Memorial Day", 5, "Mon", 25, None),
    ("Labor Day", 9, "Mon", 1, None),
    ("Columbus Day", 10, "Mon", 8, None),
    ("Thanksgiving", 11, "Thu", 22, None),
]


def _since(value: Column, year: Column, first_year: int | None) -> Column:
    return value if first_year is None else F.when(year >= first_year, value)


def _observed(day: Column) -> Column:
    """Substitute day of a holiday on a weekend, else the holiday itself."""
    weekday = F.weekday(day)
    return F.date_add(day, F.when(weekday == 5, -1).when(weekday == 6, 1).otherwise(0))


def holiday_dates(year: Column) -> list[Column]:
    """Dates that can be the next holiday for a day of ``year`` (null if not in force)."""
    dates: list[Column] = []
    for _, month, day, first_year in FIXED_HOLIDAYS:
        actual = F.make_date(year, F.lit(month), F.lit(day))
        dates.append(_since(actual, year, first_year))
        dates.append(_since(_observed(actual), year, first_year))
    for _, month, weekday, earliest, first_year in FLOATING_HOLIDAYS:
        eve = F.date_sub(F.make_date(year, F.lit(month), F.lit(earliest)), 1)
        dates.append(_since(F.next_day(eve, weekday), year, first_year))
    new_year = F.make_date(year + 1, F.lit(1), F.lit(1))
    return dates + [new_year, _observed(new_year)]


def days_to_next_holiday(day: Column) -> Column:
    """Days until the nearest holiday on or after ``day``."""
    gaps = [F.date_diff(h, day) for h in holiday_dates(F.year(day))]
    return F.least(*[F.when(gap >= 0, gap) for gap in gaps])


def recurring_event(day: Column) -> Column:
    return F.date_format(day, "MM-dd").isin(CITY_EVENT_DAYS)


def with_event_flag(df: DataFrame, day: Column, events: DataFrame | None, out: str) -> DataFrame:
    """0/1 flag of recurring event days and of the dates in ``events(event_date)``."""
    if events is None:
        return df.withColumn(out, recurring_event(day).cast("byte"))
    # At most one row per calendar day, so the table itself is not moved by day.
    dates = small_side(events.select(F.col("event_date").alias("_event")).distinct())
    flag = (recurring_event(day) | F.col("_event").isNotNull()).cast("byte")
    return df.join(dates, day == F.col("_event"), "left").withColumn(out, flag).drop("_event")


def calendar_features(df: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Training calendar of ``hour``: day of week runs 1 (Monday) to 7."""
    day = F.col("hour").cast("date")
    out = df.withColumns(
        {
            "dow": (F.weekday("hour") + 1).cast("byte"),
            "hour_of_day": F.hour("hour").cast("byte"),
            "month": F.month("hour").cast("byte"),
            "week_of_year": F.weekofyear("hour").cast("byte"),
            "is_weekend": (F.weekday("hour") >= 5).cast("byte"),
            "days_to_next_us_holiday": days_to_next_holiday(day),
        }
    )
    return with_event_flag(out, day, events, "nyc_event_flag")


def serving_calendar(df: DataFrame, ts: str, events: DataFrame | None = None) -> DataFrame:
    """Serving calendar of column ``ts``: day of week runs 0 (Monday) to 6, plus cycles."""
    at = F.col(ts)
    day = at.cast("date")
    hour, dow, month = F.hour(at), F.weekday(at), F.month(at)

    def angle(value: Column, period: int) -> Column:
        return F.lit(2.0 * math.pi) * value / F.lit(period)

    out = df.withColumns(
        {
            "hour_of_day": hour.cast("double"),
            "dow": dow.cast("double"),
            "month": month.cast("double"),
            "week_of_year": F.weekofyear(at).cast("double"),
            "is_weekend": (dow >= 5).cast("double"),
            "days_to_next_us_holiday": days_to_next_holiday(day).cast("double"),
            "hour_sin": F.sin(angle(hour, 24)),
            "hour_cos": F.cos(angle(hour, 24)),
            "dow_sin": F.sin(angle(dow, 7)),
            "dow_cos": F.cos(angle(dow, 7)),
            "month_sin": F.sin(angle(month - 1, 12)),
            "month_cos": F.cos(angle(month - 1, 12)),
        }
    )
    flagged = with_event_flag(out, day, events, "nyc_event_flag")
    return flagged.withColumn("nyc_event_flag", F.col("nyc_event_flag").cast("double"))
