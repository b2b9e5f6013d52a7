"""Dates as cameras and journals write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capture_time(written: Column, offset: Column | None = None) -> Column:
    """UTC time of ``YYYY:MM:DD HH:MM:SS`` with an optional offset; without one the wall time counts as UTC."""
    t = F.trim(written)
    part = lambda at, n: F.substring(t, at, n).try_cast("int")
    ok = (F.length(t) >= 19) & part(6, 2).between(1, 12) & part(9, 2).between(1, 31) & (part(12, 2) <= 23) & (part(15, 2) <= 59) & (part(18, 2) <= 59)
    day = F.make_date(part(1, 4), part(6, 2), F.lit(1))
    seconds = (F.unix_date(day) + part(9, 2) - 1).cast("long") * 86400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2)
    shift = offset_seconds(offset) if offset is not None else F.lit(0)
    return F.when(ok, F.timestamp_seconds(seconds - F.coalesce(shift, F.lit(0))))


def offset_seconds(offset: Column) -> Column:
    """Seconds of ``+HH:MM`` or ``-HH:MM``; null for anything else."""
    o = F.trim(offset)
    h, m = F.regexp_extract(o, r"^[+-](\d+):(\d+)$", 1).try_cast("int"), F.regexp_extract(o, r"^[+-](\d+):(\d+)$", 2).try_cast("int")
    return F.when((h <= 14) & (m <= 59), F.when(o.startswith("-"), -1).otherwise(1) * (h * 3600 + m * 60))


def exposure(n: Column, d: Column) -> Column:
    """``1/250``, or the whole number."""
    return F.when(d.isin(0, 1), n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit("/"), d.cast("string")))


def log_time(ts: Column) -> Column:
    """RFC 3339 with milliseconds and Z."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def month_floor(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
