"""Trading days of the New York stock exchange by its holiday rules, and completion of panels
over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Full days on which the exchange was closed for other reasons.
CLOSED = ("1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar: the Sunday after the paschal full moon."""
    golden, century = year % 19, F.floor(year / 100)
    moon = (19 * golden + century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 15) % 30
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.next_day(full, "Sunday")


def nth(year: Column, month: int, day: str, n: int) -> Column:
    """The n-th such week day of a month; n = -1: its last."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(F.next_day(F.date_sub(first, 1), day), 7 * (n - 1))
    return F.date_sub(F.next_day(F.last_day(first), day), 7)


def observed(date: Column) -> Column:
    """A holiday on a Saturday is kept on the Friday before, on a Sunday on the Monday after."""
    day = F.dayofweek(date)
    return F.when(day == 7, F.date_sub(date, 1)).when(day == 1, F.date_add(date, 1)).otherwise(date)


def holidays(year: Column) -> Column:
    """The exchange's holidays of a year, from 1983 on, as an array of dates (with nulls). New
    Year's Day on a Saturday is not kept."""
    fixed = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    new_year = fixed(1, 1)
    return F.array(
        F.when(F.dayofweek(new_year) != 7, observed(new_year)),
        F.when(year >= 1998, nth(year, 1, "Monday", 3)),
        nth(year, 2, "Monday", 3),
        F.date_sub(easter(year), 2),
        nth(year, 5, "Monday", -1),
        F.when(year >= 2022, observed(fixed(6, 19))),
        observed(fixed(7, 4)),
        nth(year, 9, "Monday", 1),
        nth(year, 11, "Thursday", 4),
        observed(fixed(12, 25)),
    )


def is_trading_day(day: Column, closed: tuple[str, ...] = CLOSED) -> Column:
    """No Saturday, Sunday, holiday or day of `closed`. Null days are none."""
    shut = day.isin([F.lit(c).cast("date") for c in closed]) if closed else F.lit(False)
    found = ~F.dayofweek(day).isin(1, 7) & ~F.coalesce(F.array_contains(F.array_compact(holidays(F.year(day))), day), F.lit(False)) & ~shut
    return F.coalesce(found, F.lit(False))


def trading_days(spark: SparkSession, start: str, stop: str, closed: tuple[str, ...] = CLOSED) -> DataFrame:
    """(day): the trading days from start to stop, both included: a generated table."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(stop).cast("date"))).alias("day"))
    return days.where(is_trading_day(F.col("day"), closed))


def completed(panel: DataFrame, days: DataFrame, values: list[str], key: str = "symbol", day: str = "day") -> DataFrame:
    """A row for each day of a calendar and each key of the panel, with the panel's values, or 0
    where it has none or null; rows of other days go. The keys meet the days by a generated
    array of days, at most a few thousand a century, without a join of all with all."""
    listed = days.agg(F.sort_array(F.collect_set(day)).alias("_days"))
    keys = panel.select(key).distinct().join(F.broadcast(listed))
    grid = keys.select(key, F.explode("_days").alias(day))
    kinds = dict(panel.dtypes)
    got = grid.join(panel.select(key, day, *values), [key, day], "left")
    return got.select(key, day, *[F.coalesce(F.col(v), F.lit(0).cast(kinds[v])).alias(v) for v in values])
