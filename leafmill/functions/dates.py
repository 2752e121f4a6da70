"""Formats of times and sizes, as built-in expressions in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def default_title(at: Column) -> Column:
    return F.date_format(at, "'Scan 'yyyy-MM-dd HH.mm")


def format_date(at: Column, now: Column) -> Column:
    """The time if today, ``Yesterday``, else day and month, with the year if it is another one."""
    day, today = F.to_date(at), F.to_date(now)
    return (
        F.when(day == today, F.date_format(at, "h:mm a"))
        .when(day == F.date_sub(today, 1), "Yesterday")
        .when(F.year(day) == F.year(today), F.date_format(at, "d MMM"))
        .otherwise(F.date_format(at, "d MMM yyyy"))
    )


def pdf_date(at: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+hh'mm'``."""
    return F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"), F.date_format(at, "xx").substr(1, 3), F.lit("'"), F.date_format(at, "xx").substr(4, 2), F.lit("'"))


def format_bytes(n: Column) -> Column:
    """In B, KB, MB or GB of 1024, with one decimal from KB on."""
    size = F.coalesce(n, F.lit(0)).cast("double")
    # thresholds are exact, unlike a quotient of logarithms
    unit = F.when(size >= 1024.0**3, 3).when(size >= 1024.0**2, 2).when(size >= 1024.0, 1).otherwise(0)
    names = F.array(*(F.lit(x) for x in ("B", "KB", "MB", "GB")))
    scaled = F.round(size / F.pow(F.lit(1024.0), unit), 1)
    return F.when(size == 0, "0 B").otherwise(F.concat(F.when(unit == 0, F.round(size).cast("long").cast("string")).otherwise(F.format_string("%.1f", scaled)), F.lit(" "), F.get(names, unit)))
