"""Dates, times and request keys as Column expressions."""

from pyspark.sql import Column, functions as F

from emberline.functions.geo import _col


def parse_acq_time(date, hhmm) -> Column:
    """UTC timestamp of an ISO date and an HHMM text whose leading zeros may be lost."""
    t = F.lpad(_col(hhmm), 4, "0")
    return F.to_timestamp(F.concat_ws(" ", _col(date), t), "yyyy-MM-dd HHmm")


def month_chunks(start, end) -> Column:
    """Array of (start, end) pieces of a closed date range, cut at calendar month ends."""
    start, end = _col(start), _col(end)
    firsts = F.sequence(F.trunc(start, "month"), end, F.expr("interval 1 month"))
    pieces = F.transform(firsts, lambda m: F.struct(
        F.greatest(m, start).alias("start"), F.least(F.last_day(m), end).alias("end")))
    return F.when(end < start, F.raise_error(F.lit("end is before start"))).otherwise(pieces)


def day_chunks(start, end, days: int = 5) -> Column:
    """Array of (start, end) pieces of at most `days` days."""
    start, end = _col(start), _col(end)
    firsts = F.sequence(start, end, F.expr(f"interval {days} day"))
    return F.transform(firsts, lambda d: F.struct(d.alias("start"), F.least(F.date_add(d, days - 1), end).alias("end")))


def request_key(*parts) -> Column:
    """First 16 hex digits of the SHA-256 of the "|"-joined request."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def padded_days(start, end, before: int = 5, after: int = 0) -> Column:
    return F.sequence(F.date_sub(_col(start), before), F.date_add(_col(end), after))


def month_distance(year, month, target_year, target_month) -> Column:
    return F.abs(_col(year) * 12 + _col(month) - (_col(target_year) * 12 + _col(target_month)))


def hash_int(*parts) -> Column:
    """A 32-bit integer drawn from the SHA-256 of the joined parts (reproducible in any SQL engine)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("bigint")
