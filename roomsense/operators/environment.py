"""Environment reports: Q02, Q05, Q06a, Q06b, Q11, Q14, Q18, V06, V08.

Each folds what the reference ran as several round trips into one pass over
the readings; the anchor is a scalar subquery of the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.functions import (ddmm_hhmm, env_score as score_expr, hhmm, hour_bucket, pct_change,
                                 status_fixed, trend)
from roomsense.plans.latest import last_n, latest
from roomsense.plans.windows import as_of_col, days, hours, minutes, ntz, period_hours, since
from roomsense.tables import Tables

ENV_VARS = ("co2", "voc", "temperature", "humidity")


def env_summary(t: Tables, *, as_of=None) -> DataFrame:
    """Q02: mean CO2/VOC/temp/humidity of the day before the anchor, % change
    against the day before that (both BETWEEN ends closed, C3), time of the
    latest reading.  One scan, conditional averages."""
    a = t.anchor(as_of)
    cut = a - days(1)
    rows = since(t.env, a - days(2)).select("ts", *ENV_VARS)
    cur = F.col("ts") >= cut
    prev = F.col("ts") <= cut
    aggs = [F.avg(F.when(cur, F.col(v))).alias(f"{v}_cur") for v in ENV_VARS]
    aggs += [F.avg(F.when(prev, F.col(v))).alias(f"{v}_prev") for v in ENV_VARS]
    aggs.append(F.max(F.when(cur, F.col("ts"))).alias("last_ts"))
    g = rows.agg(*aggs)
    out = [F.round(F.coalesce(F.col(f"{v}_cur"), F.lit(0.0)), 1).alias(f"{v}_avg") for v in ENV_VARS]
    out.append(F.coalesce(hhmm("last_ts"), F.lit("--")).alias("reading_time"))
    out += [pct_change(F.col(f"{v}_cur"), F.col(f"{v}_prev")).alias(f"{v}_change_pct") for v in ENV_VARS]
    return g.select(*out)


def env_summary_trends(t: Tables, *, as_of=None) -> DataFrame:
    """Q02 + V04: the summary with a down/up/flat direction per variable."""
    s = env_summary(t, as_of=as_of)
    return s.select("*", *[trend(F.col(f"{v}_change_pct")).alias(f"{v}_trend") for v in ENV_VARS])


def env_hourly(t: Tables, period: str = "24h", *, as_of=None) -> DataFrame:
    """Q05: hourly means over 24h / 7d / 30d before the anchor.  An N-hour
    window touches up to N+1 buckets (C3); empty hours give no row (C4); the
    label is the earliest reading of the bucket (C5)."""
    a = t.anchor(as_of)
    return _hourly(since(t.env, a - hours(period_hours(period))))


def _hourly(readings: DataFrame) -> DataFrame:
    rows = readings.select("ts", *ENV_VARS)
    g = rows.groupBy(hour_bucket("ts").alias("bucket")).agg(
        F.min("ts").alias("first_ts"), *[F.avg(v).alias(v) for v in ENV_VARS])
    return g.select(
        "bucket", ddmm_hhmm("first_ts").alias("label"),
        F.round(F.coalesce("co2", F.lit(0.0)), 1).alias("co2"),
        F.round(F.coalesce("voc", F.lit(0.0)), 1).alias("voc"),
        F.round(F.coalesce("temperature", F.lit(0.0)), 1).alias("temp"),
        F.round(F.coalesce("humidity", F.lit(0.0)), 1).alias("humid"),
    ).orderBy("bucket")


def env_current(t: Tables, period: str = "24h", *, as_of=None) -> DataFrame:
    """The last hourly bucket of Q05 shown as the current value.  The
    anchor is the newest reading, so only its own hour is read (cut where the
    period is shorter)."""
    a = t.anchor(as_of)
    return _hourly(since(t.env, F.greatest(hour_bucket(a), a - hours(period_hours(period))))).orderBy(F.col("bucket").desc()).limit(1)


def co2_humidity_points(t: Tables, period: str = "24h", *, as_of=None) -> DataFrame:
    """Q05 points, VOC scaled by the window's max VOC (floored at 1) to a
    hue 240 - 180 * r.  The max is a window over the hourly rows only (at most
    721), not over readings."""
    h = env_hourly(t, period, as_of=as_of)
    max_voc = F.greatest(F.max("voc").over(_whole()), F.lit(1.0))
    ratio = F.col("voc") / max_voc
    return h.select("bucket", "co2", "humid", "voc",
                    F.round(ratio, 4).alias("voc_ratio"),
                    F.round(F.lit(240.0) - ratio * F.lit(180.0), 2).alias("hue"))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()


def env_score(t: Tables) -> DataFrame:
    """Latest reading (ties on ts broken by id) -> 0-100 score and
    status.  An empty table scores 100 / NORMAL (C15)."""
    # the newest reading has ts = max(ts): read only rows at that time (on
    # day-partitioned facts, one day partition)
    newest = since(t.env_newest(), t.latest_env_time())
    r = latest(newest, [], ["co2", "voc", "temperature", "humidity", "noise", "ts"])
    co2 = F.coalesce(F.col("r.co2"), F.lit(0.0))
    voc = F.coalesce(F.col("r.voc"), F.lit(0.0))
    return r.select(
        score_expr(co2, voc).alias("score"), status_fixed(co2, voc).alias("status"),
        co2.alias("co2"), voc.alias("voc"),
        F.coalesce(F.col("r.temperature"), F.lit(0.0)).alias("temperature"),
        F.coalesce(hhmm("r.ts"), F.lit("--")).alias("reading_time"),
    )


def peak_by_sector(t: Tables, *, as_of=None) -> DataFrame:
    """Sector (by name, same names merge) with the highest CO2 and the
    highest VOC in the day before the anchor; ties -> lower name (C6).  Readings
    are reduced to one row per sensor before they meet the dimension."""
    a = t.anchor(as_of)
    rows = since(t.env, a - days(1)).groupBy("sensor_id").agg(F.max("co2").alias("mc"), F.max("voc").alias("mv"))
    per = (rows.join(t.sensor_sector().select("sensor_id", "sector_name"), "sensor_id")
           .groupBy("sector_name").agg(F.max("mc").alias("mc"), F.max("mv").alias("mv")))
    one = per.agg(
        F.min_by("sector_name", F.struct(-F.col("mc"), F.col("sector_name"))).alias("co2_sector"),
        F.max("mc").alias("co2_peak"),
        F.min_by("sector_name", F.struct(-F.col("mv"), F.col("sector_name"))).alias("voc_sector"),
        F.max("mv").alias("voc_peak"))
    return one.select(
        F.coalesce("co2_sector", F.lit("N/D")).alias("co2_peak_sector"),
        F.coalesce(F.round("co2_peak", 0), F.lit(0.0)).alias("co2_peak_value"),
        F.coalesce("voc_sector", F.lit("N/D")).alias("voc_peak_sector"),
        F.coalesce(F.round("voc_peak", 0), F.lit(0.0)).alias("voc_peak_value"))


def sensor_window(t: Tables, sensor_id: int | None = None, around=None, half_width_minutes: int = 30,
                  limit: int = 30, *, as_of=None) -> DataFrame:
    """Q11: one sensor's (or, with ``sensor_id=None``, every sensor's)
    readings within +-half_width of ``around`` (closed), else the hour before
    ``as_of``; the first ``limit`` ascending per sensor (O02)."""
    env = t.env
    if sensor_id is not None:
        env = env.where(F.col("sensor_id") == F.lit(sensor_id))
    if around is not None:
        c = ntz(around)
        w = minutes(half_width_minutes)
        lo, hi = c - w, c + w
        env = env.where(F.col("ts").between(lo, hi))
        if "day" in env.columns:
            env = env.where(F.col("day").between(F.to_date(lo), F.to_date(hi)))
    else:
        env = since(env, as_of_col(as_of) - hours(1))
    ranked = last_n(env.select("id", "ts", "sensor_id", "co2", "voc", "temperature"), ["sensor_id"], limit,
                    rank="pos", newest_first=False)
    return ranked.select("sensor_id", "pos", "co2", "voc", "temperature", hhmm("ts").alias("time_label"), "ts")


def latest_status(t: Tables) -> DataFrame:
    """Q14: latest reading per sensor with its sector and fixed-limit status.
    Aggregate first (one row per sensor), then join the dimensions."""
    r = latest(t.env_newest(), ["sensor_id"], ["ts", "co2", "voc", "temperature", "humidity", "noise"])
    j = r.join(t.sensor_sector(), "sensor_id")
    return j.select("sector_id", "sector_name", "sector_type", "sensor_id",
                    F.col("r.ts").alias("last_ts"), F.col("r.co2").alias("co2"), F.col("r.voc").alias("voc"),
                    F.col("r.temperature").alias("temperature"), F.col("r.humidity").alias("humidity"),
                    F.col("r.noise").alias("noise"), status_fixed("r.co2", "r.voc").alias("status"))


def avg_co2_by_type(t: Tables) -> DataFrame:
    """Q18: mean CO2 by sector type.  Readings are pre-aggregated per sensor
    (sum, count) before the join, so only one row per sensor meets the
    dimensions whatever the join strategy."""
    per_sensor = t.env.groupBy("sensor_id").agg(F.sum("co2").alias("s"), F.count(F.lit(1)).alias("n"))
    j = per_sensor.join(t.sensor_sector().select("sensor_id", "sector_type"), "sensor_id")
    return j.groupBy("sector_type").agg(F.round(F.sum("s") / F.sum("n"), 2).alias("co2_avg"))
