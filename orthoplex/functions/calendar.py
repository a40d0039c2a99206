"""Calendar tables with period flags relative to a given day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days of the longest calendar; it bounds what a join may broadcast.
MAX_DAYS = 366 * 400


def date_key(day: Column) -> Column:
    """yyyymmdd as an int."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def period_flags(day: Column, as_of: dt.date) -> dict[str, Column]:
    """Year, quarter and month to date, the year itself, and last year's days up to the same day of the year."""
    until = day <= F.lit(as_of)
    year = F.year(day) == as_of.year
    return {
        "ytd_flag": until & year,
        "prior_year_ytd_flag": (F.year(day) == as_of.year - 1) & (F.dayofyear(day) <= as_of.timetuple().tm_yday),
        "current_year_flag": year,
        "qtd_flag": until & year & (F.quarter(day) == (as_of.month - 1) // 3 + 1),
        "mtd_flag": until & year & (F.month(day) == as_of.month),
    }


def calendar(spark: SparkSession, first: dt.date = dt.date(2020, 1, 1), last: dt.date = dt.date(2030, 12, 31), as_of: dt.date | None = None) -> DataFrame:
    """A row per day: date_key, full_date, year, quarter, month and the flags relative to ``as_of`` (today, if not given)."""
    if (last - first).days >= MAX_DAYS:
        raise ValueError(f"a calendar holds {MAX_DAYS} days at most")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("full_date"))
    day = F.col("full_date")
    out = days.select(date_key(day).alias("date_key"), day, F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"))
    return out.select("*", *[c.alias(n) for n, c in period_flags(day, as_of or dt.date.today()).items()])


def calendar_for(fact: DataFrame, column: str, as_of: dt.date | None = None) -> DataFrame:
    """A calendar from the first to the last day of a fact's date column."""
    lo, hi = fact.agg(F.min(F.col(column).cast("date")), F.max(F.col(column).cast("date"))).first()
    today = dt.date.today()
    return calendar(fact.sparkSession, lo or today, hi or today, as_of)
