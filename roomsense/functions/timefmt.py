"""Time formatting and bucketing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["hhmm", "hhmmss", "ddmm", "ddmm_hhmm", "ddmm_hhmmss", "hour_bucket", "minute_bucket", "second_floor",
           "minutes_between"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hhmm(ts) -> Column:
    return F.date_format(_c(ts), "HH:mm")


def hhmmss(ts) -> Column:
    return F.date_format(_c(ts), "HH:mm:ss")


def ddmm(ts) -> Column:
    return F.date_format(_c(ts), "dd/MM")


def ddmm_hhmm(ts) -> Column:
    return F.date_format(_c(ts), "dd/MM HH:mm")


def ddmm_hhmmss(ts) -> Column:
    return F.date_format(_c(ts), "dd/MM HH:mm:ss")


def _ntz_floor(ts, unit: str) -> Column:
    """Truncate a TIMESTAMP_NTZ from its own fields: no session time zone is
    involved (date_trunc would go through TIMESTAMP and the session zone, C2)."""
    t = _c(ts)
    zero = F.lit(0)
    minute = F.minute(t) if unit in ("minute", "second") else zero
    second = F.second(t) if unit == "second" else zero
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), minute, second)


def hour_bucket(ts) -> Column:
    return _ntz_floor(ts, "hour")


def minute_bucket(ts) -> Column:
    return _ntz_floor(ts, "minute")


def second_floor(ts) -> Column:
    return _ntz_floor(ts, "second")


def minutes_between(start, end) -> Column:
    """TIMESTAMPDIFF(MINUTE, start, end): whole minutes, truncated toward zero."""
    return F.timestamp_diff("MINUTE", _c(start), _c(end))
