"""The trading week, sessions and time buckets as columns.

Weeks and sessions follow local clocks, so they move with each zone's daylight
saving. Timestamps are instants; sessions run in UTC (``session.pin``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The week's zone and hours, the session windows, and the timeframes in seconds.
WEEK_ZONE, WEEK_HOUR = "America/New_York", 17
ROLL_FROM, ROLL_TO = 16, 18
WINDOWS = (("london", "Europe/London", 8, 16), ("new_york", "America/New_York", 8, 17), ("tokyo", "Asia/Tokyo", 9, 18))
OVERLAP, OTHER = "london_ny_overlap", "sydney"
SESSIONS = ("tokyo", "london", OVERLAP, "new_york", OTHER)
TIMEFRAMES = {"1min": 60, "5min": 300, "15min": 900, "30min": 1800, "1h": 3600, "4h": 14400, "1D": 86400}
SPELLINGS = {"m": "min", "min": "min", "t": "min", "h": "h", "d": "D"}


class TimeframeError(ValueError):
    """A timeframe that is not one of ``TIMEFRAMES``."""


def timeframe(name: str) -> str:
    """The canonical spelling of a timeframe: ``5m``, ``5T`` and ``5min`` are ``5min``; ``60min`` is ``1h``."""
    digits = "".join(c for c in name if c.isdigit()) or "1"
    unit = SPELLINGS.get(name[len(digits) if name[:1].isdigit() else 0 :].strip().lower())
    if unit:
        seconds = int(digits) * {"min": 60, "h": 3600, "D": 86400}[unit]
        for alias, size in TIMEFRAMES.items():
            if size == seconds:
                return alias
    raise TimeframeError(f"unknown timeframe {name!r}; known: {', '.join(TIMEFRAMES)}")


def micros(name: str) -> int:
    """Width of a timeframe in microseconds."""
    return TIMEFRAMES[timeframe(name)] * 1_000_000


def bucket_micros(ts: Column, width: Column | int) -> Column:
    """Opening microsecond of the epoch-aligned bucket, in integers throughout."""
    us = F.unix_micros(ts)
    return us - F.pmod(us, F.lit(width) if isinstance(width, int) else width)


def bucket(ts: Column, width: Column | int) -> Column:
    return F.timestamp_micros(bucket_micros(ts, width))


def local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def market_open(ts: Column) -> Column:
    """Sunday 17:00 to Friday 17:00 in New York."""
    t = local(ts, WEEK_ZONE)
    day, hour = F.weekday(t), F.hour(t)
    return ~((day == 5) | ((day == 6) & (hour < WEEK_HOUR)) | ((day == 4) & (hour >= WEEK_HOUR)))


def reaches_feed(ts: Column) -> Column:
    """Whether the hour or one beside it is open."""
    hour = F.expr("INTERVAL 1 HOUR")
    return market_open(ts) | market_open(ts - hour) | market_open(ts + hour)


def session_label(ts: Column) -> Column:
    active = {}
    for name, zone, start, stop in WINDOWS:
        t = local(ts, zone)
        active[name] = (F.weekday(t) <= 4) & (F.hour(t) >= start) & (F.hour(t) < stop)
    return F.when(active["london"] & active["new_york"], OVERLAP).when(active["london"], "london").when(active["new_york"], "new_york").when(active["tokyo"], "tokyo").otherwise(OTHER)


def week_open(ts: Column) -> Column:
    """The latest Sunday 17:00 New York at or before ``ts``, as an instant."""
    t = local(ts, WEEK_ZONE)
    sunday = F.date_sub(F.to_date(t), (F.weekday(t) + 1) % 7)
    at = sunday.cast("timestamp") + F.expr(f"INTERVAL {WEEK_HOUR} HOURS")
    return F.to_utc_timestamp(F.when(at > t, at - F.expr("INTERVAL 7 DAYS")).otherwise(at), WEEK_ZONE)


def week_close(ts: Column) -> Column:
    """Five local days after the week's open."""
    return F.to_utc_timestamp(local(week_open(ts), WEEK_ZONE) + F.expr("INTERVAL 5 DAYS"), WEEK_ZONE)


def roll_hour(ts: Column) -> Column:
    """16:00 to 18:00 in New York, around the daily roll."""
    hour = F.hour(local(ts, WEEK_ZONE))
    return (hour >= ROLL_FROM) & (hour < ROLL_TO)
