"""Date and time column functions; the session's time zone is UTC."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"
MAX_SPAN = timedelta(days=7)
#: The words of a written period.
YEAR, MONTH, DAY, FROM, UNTIL = "년 ", "월 ", "일", "부터", "까지"


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_text(ts: Column, form: str = "yyyy-MM-dd HH:mm:ss", zone: str = ZONE) -> Column:
    return F.date_format(local(ts, zone), form)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def week_start(ts: Column, zone: str = ZONE) -> Column:
    """Monday of the local week."""
    return F.to_date(F.date_trunc("week", local(ts, zone)))


def period_text(start: Column, stop: Column, zone: str = ZONE) -> Column:
    """A local day's date and ``start~stop``; across days both dates, the second without its year where that is the same; seconds only where one of the times has any."""
    a, b = local(start, zone), local(stop, zone)
    exact = (F.second(a) != 0) | (F.second(b) != 0)
    clock = lambda t: F.when(exact, F.date_format(t, "HH:mm:ss")).otherwise(F.date_format(t, "HH:mm"))
    day = lambda t: F.concat(F.month(t).cast("string"), F.lit(MONTH), F.dayofmonth(t).cast("string"), F.lit(DAY))
    dated = lambda t: F.concat(F.year(t).cast("string"), F.lit(YEAR), day(t))
    end = F.when(F.year(a) == F.year(b), day(b)).otherwise(dated(b))
    across = F.concat(dated(a), F.lit(" "), clock(a), F.lit(f"{FROM} "), end, F.lit(" "), clock(b), F.lit(UNTIL))
    return F.when(F.to_date(a) == F.to_date(b), F.concat(dated(a), F.lit(" "), clock(a), F.lit("~"), clock(b))).otherwise(across)


def parse_aware(c: Column) -> Column:
    """ISO 8601 text with an offset as an instant; null for naive or malformed text."""
    aware = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(aware, F.try_to_timestamp(c))


def name_time(name: Column, zone: str = ZONE) -> Column:
    """struct<ts, source> from a file name: ``yyyyMMdd_HHmmss`` is local, ``yyyyMMddTHHmmssZ`` is UTC; null otherwise."""
    here, there = F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.regexp_extract(name, r"(\d{8}T\d{6})Z", 1)
    as_local = F.to_utc_timestamp(F.try_to_timestamp(here, F.lit("yyyyMMdd_HHmmss")), zone)
    as_utc = F.try_to_timestamp(there, F.lit("yyyyMMdd'T'HHmmss"))
    return F.when(as_local.isNotNull(), F.struct(as_local.alias("ts"), F.lit("local_name").alias("source"))).when(as_utc.isNotNull(), F.struct(as_utc.alias("ts"), F.lit("utc_name").alias("source")))


def duration_warning(seconds: Column, expected: float, low: float = 0.8, high: float = 1.2) -> Column:
    """``short`` or ``long`` outside low and high times the expected length, else null."""
    return F.when(seconds < expected * low, "short").when(seconds > expected * high, "long")


@dataclass(frozen=True)
class Span:
    start: datetime
    stop: datetime
    notes: tuple[str, ...] = ()


def clamp_span(start: datetime, stop: datetime, now: datetime, most: timedelta = MAX_SPAN) -> Span:
    """A search's period: in order, not beyond now, not longer than ``most``.

    A period that begins in the future is taken twelve hours back once (a mistaken afternoon); if it still
    ends ahead of now it is an error.
    """
    notes: list[str] = []
    if start >= stop:
        raise ValueError("EMPTY_RANGE")
    if start >= now:
        start, stop = start - timedelta(hours=12), stop - timedelta(hours=12)
        notes.append("moved_back")
        if stop > now:
            raise ValueError("FUTURE_RANGE")
    elif stop > now:
        stop = now
        notes.append("cut_at_now")
    if stop - start > most:
        start = stop - most
        notes.append("shortened")
    return Span(start, stop, tuple(notes))
