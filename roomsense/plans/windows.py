"""Time windows: the two clocks (anchor and as_of), periods, closed edges.

* anchor (F03): latest environment reading time, else ``as_of``; a scalar
  subquery planned once inside the report's own job.
* as_of (F04/X07): the caller's "now"; defaults to the session's local time.
* windows are ``ts >= start`` (closed below, open above, F02) or BETWEEN with
  both ends closed (F05).  When the fact carries a ``day`` partition column
  the matching day predicate is added so the scan prunes partitions.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD_HOURS = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24}
PERIOD_DAYS = {"24h": 1, "7d": 7, "30d": 30}


def period_hours(period: str) -> int:
    if period not in PERIOD_HOURS:
        raise ValueError(f"unknown period {period!r}; expected one of {sorted(PERIOD_HOURS)}")
    return PERIOD_HOURS[period]


def period_days(period: str) -> int:
    if period not in PERIOD_DAYS:
        raise ValueError(f"unknown period {period!r}; expected one of {sorted(PERIOD_DAYS)}")
    return PERIOD_DAYS[period]


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime or 'YYYY-MM-DD HH:MM:SS' text."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def as_of_col(as_of=None) -> Column:
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of
    return ntz(as_of)


def latest_time(env: DataFrame) -> Column:
    """max(ts) as a scalar subquery.  On a day-partitioned fact the newest
    day comes first (a partition column: file footers only), then max(ts) is
    read from that one day's partition instead of the whole table."""
    if "day" in env.columns:
        last_day = env.select(F.max("day")).scalar()
        return env.where(F.col("day") >= last_day).select(F.max("ts")).scalar()
    return env.select(F.max("ts")).scalar()


def anchor(env: DataFrame, as_of=None) -> Column:
    """max(ts) of the environment readings, else ``as_of``."""
    return F.coalesce(latest_time(env), as_of_col(as_of))


def hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def since(df: DataFrame, start: Column, ts: str = "ts") -> DataFrame:
    """``ts >= start``; plus ``day >= date(start)`` on day-partitioned facts."""
    out = df.where(F.col(ts) >= start)
    if "day" in df.columns:
        out = out.where(F.col("day") >= F.to_date(start))
    return out


def between(df: DataFrame, lo: Column, hi: Column, ts: str = "ts") -> DataFrame:
    out = df.where(F.col(ts).between(lo, hi))
    if "day" in df.columns:
        out = out.where(F.col("day").between(F.to_date(lo), F.to_date(hi)))
    return out
