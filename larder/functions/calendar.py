"""Calendar columns and US federal holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weekday numbers, Monday = 0.
MON, THU, FRI, SAT, SUN = 0, 3, 4, 5, 6

# Federal holidays on a set date (name, month, day, first year).
SET_DATES = [
    ("New Year's Day", 1, 1, 1870),
    ("Juneteenth", 6, 19, 2021),
    ("Independence Day", 7, 4, 1870),
    ("Veterans Day", 11, 11, 1978),
    ("Christmas Day", 12, 25, 1870),
]

# Federal holidays on the n-th weekday of a month, given as the span of
# month days that weekday can fall on (name, month, weekday, first day, last day, first year).
FLOATING = [
    ("Martin Luther King Jr. Day", 1, MON, 15, 21, 1986),
    ("Washington's Birthday", 2, MON, 15, 21, 1971),
    ("Memorial Day", 5, MON, 25, 31, 1971),
    ("Labor Day", 9, MON, 1, 7, 1894),
    ("Columbus Day", 10, MON, 8, 14, 1971),
    ("Thanksgiving", 11, THU, 22, 28, 1942),
]


def date_parts(date: Column) -> dict[str, Column]:
    weekday = F.weekday(date)
    return {
        "day_of_week": weekday,
        "day_of_month": F.day(date),
        "month": F.month(date),
        "year": F.year(date),
        "is_weekend": weekday.isin(SAT, SUN).cast("int"),
    }


def _on(date: Column, month: int, day: int, first_year: int) -> Column:
    return (F.month(date) == month) & (F.day(date) == day) & (F.year(date) >= first_year)


def us_holiday(date: Column) -> Column:
    """Name of the federal holiday on ``date``, null on other days.

    A set date on a Saturday is also kept on the Friday before, one on a Sunday on
    the Monday after. A CASE over date parts: no lookup table and no year limit.
    """
    weekday = F.weekday(date)
    case = None

    def add(cond: Column, name: str) -> None:
        nonlocal case
        case = F.when(cond, name) if case is None else case.when(cond, name)

    for name, month, first, lo, hi, since in FLOATING:
        add(
            (F.month(date) == month) & (weekday == first) & F.day(date).between(lo, hi) & (F.year(date) >= since),
            name,
        )
    for name, month, day, since in SET_DATES:
        add(_on(date, month, day, since), name)
    for name, month, day, since in SET_DATES:
        add((weekday == FRI) & _on(F.date_add(date, 1), month, day, since), f"{name} (observed)")
        add((weekday == MON) & _on(F.date_sub(date, 1), month, day, since), f"{name} (observed)")
    return case


def is_us_holiday(date: Column) -> Column:
    return us_holiday(date).isNotNull().cast("int")


def holiday_dimension(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per holiday date in the years given: (date, holiday)."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))
        ).alias("date")
    )
    return days.withColumn("holiday", us_holiday(F.col("date"))).where("holiday is not null")
