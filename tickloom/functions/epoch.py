"""Dates from epoch microseconds, independent of the session's time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def utc_date(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(DAY_US)).cast("int"))


def utc_month(us: Column) -> Column:
    return F.date_format(utc_date(us), "yyyy-MM")


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp; an NTZ timestamp counts as UTC."""
    return F.unix_micros(ts.cast("timestamp"))
