"""Landed telemetry feed.

The reference polls an HTTP API; here the feed lands as JSON-lines files
(one record per line, the API's keys) in a landing folder.  The HTTP client
itself is not rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomsense import schemas
from roomsense.plans.windows import as_of_col, days


def feed_schema(kind: str):
    if kind not in ("env", "occ"):
        raise ValueError(f"unknown feed {kind!r}; expected 'env' or 'occ'")
    return schemas.FEED_ENV if kind == "env" else schemas.FEED_OCCUPANCY


def read_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Batch read of landed records with the declared schema (no inference)."""
    return spark.read.schema(feed_schema(kind)).json(path)


def stream_feed(spark: SparkSession, path: str, kind: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The landing folder as a file-source stream; the checkpoint of the
    query that consumes it records which files were taken (replaces the
    reference's id mark)."""
    r = spark.readStream.schema(feed_schema(kind))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.json(path)


def in_initial_window(dias: int = 1, *, as_of=None) -> Column:
    """Dates from date(now + 1 day - dias) to date(now + 1 day), both included."""
    end = as_of_col(as_of) + days(1)
    start = end - days(dias)
    return F.to_date("ts").between(F.to_date(start), F.to_date(end))


def initial_window(parsed: DataFrame, dias: int = 1, *, as_of=None) -> DataFrame:
    """First load by dates."""
    return parsed.where(in_initial_window(dias, as_of=as_of))


def high_water_mark(stored: DataFrame) -> Column:
    """Max stored id as a scalar subquery (NULL when empty)."""
    return stored.select(F.max("id")).scalar()


def incremental(records: DataFrame, mark) -> DataFrame:
    """Records with an id above the mark; no mark -> nothing (the
    reference skips the refresh when the table is empty)."""
    if mark is None:
        return records.where(F.lit(False))
    m = mark if isinstance(mark, Column) else F.lit(mark)
    return records.where(F.col("id") > m)
