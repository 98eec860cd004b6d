"""Anchored ranges, tolerant parsing and freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let

WINDOW_HOURS = 48
ZONE = "Asia/Seoul"


def collection_range(now: dt.datetime, hours: int = WINDOW_HOURS) -> tuple[dt.datetime, dt.datetime]:
    """From and to: the latest 09:00 in UTC+9 (midnight UTC) at or before now, and `hours` before it."""
    if now.tzinfo is None:
        raise ValueError("now needs a time zone")
    to = now.astimezone(dt.UTC).replace(hour=0, minute=0, second=0, microsecond=0)
    return to - dt.timedelta(hours=hours), to


def anchored(ts: Column) -> Column:
    """The end of the range that a run at ts has."""
    return F.date_trunc("day", ts)


def in_range(ts: Column, start: Column, end: Column) -> Column:
    """Both ends count."""
    return ts.between(start, end)


def parsed(text: Column) -> Column:
    """A timestamp from ISO or RFC 822 text, with an offset or in UTC; null if it is neither."""

    def tried(x: Column) -> Column:
        formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy.MM.dd HH:mm", "yyyy.MM.dd", "yyyy/MM/dd")
        return F.coalesce(x["text"].try_cast("timestamp"), *(F.try_to_timestamp(x["plain"], F.lit(f)) for f in formats))

    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z]{3},\s*", ""), r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    return let(let(F.trim(text), lambda x: F.struct(x.alias("text"), plain(x).alias("plain"))), tried)


def local_iso(ts: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, ZONE), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+09:00"))


def local_date(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, ZONE), "yyyy-MM-dd")


def micros(ts: Column) -> Column:
    """Microseconds since 1970; times without a zone are taken in the session's."""
    return F.unix_micros(ts.cast("timestamp"))


def freshness(ts: Column, start: Column, end: Column) -> Column:
    """0 to 4, halves up."""
    share = (micros(end) - micros(ts)) / (micros(end) - micros(start))
    return F.greatest(F.lit(0), F.least(F.lit(4), F.floor(4 * (1 - share) + 0.5).cast("int")))


def healthy(success: Column, ran: Column, now: Column, hours: int = 36) -> Column:
    age = micros(now) - micros(ran)
    return success & (age >= 0) & (age <= hours * 3_600_000_000)


def retry_seconds(text: Column) -> Column:
    """Seconds of a duration such as 1h2m3.5s or 250ms; null if there is none."""
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9.]+(?:ms|h|m|s))"), F.lit(1))

    def worth(p: Column) -> Column:
        n, u = F.regexp_extract(p, r"^([0-9.]+)", 1).cast("double"), F.regexp_extract(p, r"([a-z]+)$", 1)
        out = F.lit(0.0)
        for k, v in unit.items():
            out = F.when(u == k, n * v).otherwise(out)
        return out

    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a + worth(p)))


def label(ts: Column, pattern: str = "yyyy.MM.dd HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, ZONE), pattern)


def briefing_date(generated: Column) -> Column:
    """The date at the start of an ISO text, if there is one."""
    return F.nullif(F.regexp_extract(generated, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
