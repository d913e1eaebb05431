"""Code columns compared in binary are normalised once, at load
(trimmed, upper case), instead of relying on a case-insensitive collation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALERT_CODES = ("parameter", "severity", "status")
THRESHOLD_CODES = ("parameter",)


def upper_codes(df: DataFrame, columns) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.upper(F.trim(F.col(c))) for c in present})
