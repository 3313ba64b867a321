"""Dates kept as ISO text, their strata, and small number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
UNDATED = "undated"


def message_date(stamp: Column) -> Column:
    """First ten characters when they form a date, else ``undated``."""
    day = F.substring(F.coalesce(stamp, F.lit("")), 1, 10)
    return F.when(day.rlike(ISO_DATE), day).otherwise(UNDATED)


def date_from_millis(millis: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd"), F.lit(""))


def known(date: Column) -> Column:
    """The date, or null where it is not known."""
    return F.when(date != UNDATED, date)


def _quarter(date: Column) -> Column:
    month = F.substring(date, 6, 2).cast("int")
    return F.concat(F.substring(date, 1, 4), F.lit("-Q"), F.floor((month - 1) / 3 + 1).cast("string"))


def quarter(date: Column) -> Column:
    return F.when(date.rlike(r"^\d{4}-\d{2}"), _quarter(date)).otherwise("unknown")


def stratum(source: Column, date: Column) -> Column:
    """Source and quarter, for counting independent support."""
    part = F.when(date.rlike(ISO_DATE), _quarter(date)).otherwise(UNDATED)
    return F.concat_ws(":", source, part)


def month_stratum(source: Column, date: Column) -> Column:
    return F.concat_ws(":", source, F.substring(date, 1, 7))


def months_between(first: Column, last: Column) -> Column:
    """Calendar months touched, both ends included; 0 when a date is not usable."""
    year = lambda d: F.substring(d, 1, 4).try_cast("int")
    month = lambda d: F.substring(d, 6, 2).try_cast("int")
    span = (year(last) - year(first)) * 12 + month(last) - month(first) + 1
    return F.coalesce(F.when(span.isNotNull(), F.greatest(F.lit(1), span)), F.lit(0))


def short_count(n: Column) -> Column:
    """1234567 -> 1.2M, 3456 -> 3K."""
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(F.floor(n / 1000).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def observed_at(date: Column, modified: Column) -> Column:
    """Midnight of the message date, else of the day the file changed."""
    day = F.coalesce(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), modified)
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z"))


def utc_millis(stamp: Column) -> Column:
    """ISO UTC text with milliseconds; null where the text is no such time."""
    valid = F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"), stamp)
    return iso_millis(valid.try_cast("timestamp"))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def add_days(stamp: Column, days: int) -> Column:
    return iso_millis(stamp.try_cast("timestamp") + F.make_dt_interval(F.lit(days)))
