"""Parts of Unix seconds in UTC, as doubles: by the real calendar, and by months of 30 and years of 365 days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(t: Column) -> Column:
    """The date of a count of seconds, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), days(t).cast("int"))


def days(t: Column) -> Column:
    return F.floor(t / F.lit(86400))


def timestamp(t: Column) -> Column:
    return t.cast("double")


def hour(t: Column) -> Column:
    return F.floor(F.pmod(t, F.lit(86400)) / 3600).cast("double")


def minute(t: Column) -> Column:
    return F.floor(F.pmod(t, F.lit(3600)) / 60).cast("double")


def day_of_week(t: Column) -> Column:
    """Sunday is 0."""
    return F.pmod(days(t) + 4, F.lit(7)).cast("double")


def day_of_month(t: Column) -> Column:
    return F.dayofmonth(at(t)).cast("double")


def day_of_year(t: Column) -> Column:
    return F.dayofyear(at(t)).cast("double")


def days_in_month(t: Column) -> Column:
    return F.dayofmonth(F.last_day(at(t))).cast("double")


def month(t: Column) -> Column:
    return F.month(at(t)).cast("double")


def year(t: Column) -> Column:
    return F.year(at(t)).cast("double")


def day_of_month_approx(t: Column) -> Column:
    return (F.pmod(days(t), F.lit(30)) + 1).cast("double")


def day_of_year_approx(t: Column) -> Column:
    return (F.pmod(days(t), F.lit(365)) + 1).cast("double")


def days_in_month_approx(t: Column) -> Column:
    return F.when(t.isNotNull(), 30.0)


def month_approx(t: Column) -> Column:
    return (F.pmod(F.floor(days(t) / 30), F.lit(12)) + 1).cast("double")


def year_approx(t: Column) -> Column:
    return (F.floor(days(t) / 365) + 1970).cast("double")


PARTS = {"timestamp": timestamp, "hour": hour, "minute": minute, "day_of_week": day_of_week, "day_of_month": day_of_month, "day_of_year": day_of_year, "days_in_month": days_in_month, "month": month, "year": year}
APPROX = {"day_of_month": day_of_month_approx, "day_of_year": day_of_year_approx, "days_in_month": days_in_month_approx, "month": month_approx, "year": year_approx}
