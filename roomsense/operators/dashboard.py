"""Dashboard reports: Q01, Q06 (a-d), Q07.

Q07 replaces the reference's 1 + 5 x sectors round trips with one plan whose
job count does not depend on the number of sectors: the per-sector parts are
grouped aggregates left-joined to the sectors, the sector-independent parts
(latest reading, 6-point hourly history) are scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.functions import hour_bucket, status_display, status_fixed, status_text, tile_text
from roomsense.operators.environment import env_score, peak_by_sector
from roomsense.plans.joins import maybe_broadcast
from roomsense.plans.latest import latest
from roomsense.plans.windows import days, hours, since
from roomsense.tables import Tables


def sector_directory(t: Tables) -> DataFrame:
    """Q01: active sectors with their number of active sensors (0 if none).
    The sensor filter sits before the left join (J04)."""
    counts = (t.sensors.where(F.col("active") == 1).groupBy("sector_id")
              .agg(F.count("sensor_id").alias("sensor_count")))
    counts = maybe_broadcast(counts, t.is_small("sensors"))
    sec = t.sectors.where(F.col("active") == 1).select("sector_id", "sector_name", "sector_type", "max_capacity")
    return (sec.join(counts, "sector_id", "left")
            .select("sector_id", "sector_name", "sector_type", "max_capacity",
                    F.coalesce("sensor_count", F.lit(0)).cast("bigint").alias("sensor_count"))
            .orderBy("sector_id"))


def odour_events(t: Tables, *, as_of=None) -> DataFrame:
    """VOC alerts (severity other than NORMAL) fired in the day before
    the environment anchor (the alert table uses the readings' clock, C1)."""
    a = t.anchor(as_of)
    hit = (F.col("parameter") == "VOC") & (F.col("severity") != "NORMAL")
    return since(t.alerts, a - days(1), ts="fired_at").where(hit).agg(F.count(F.lit(1)).alias("odour_events"))


def active_sensors(t: Tables) -> DataFrame:
    """Q06d: number of sensors with active = 1."""
    return t.sensors.where(F.col("active") == 1).agg(F.count(F.lit(1)).alias("active_sensors"))


def dashboard_summary(t: Tables, *, as_of=None) -> DataFrame:
    """Q06: the whole dashboard summary row (score, peaks, odour events,
    active sensors), each part a scalar subquery of one plan."""
    parts = {
        "env": env_score(t),
        "peaks": peak_by_sector(t, as_of=as_of),
        "odour": odour_events(t, as_of=as_of),
        "sensors": active_sensors(t),
    }
    cols = []
    for name, df in parts.items():
        s = df.select(F.struct(*df.columns).alias("s")).scalar()
        cols += [s.getField(c).alias(c) for c in df.columns]
    row = t.sectors.sparkSession.range(1).select(*cols)
    return row.withColumn("status_display", status_display("status"))


def _recent_window(t: Tables, as_of, window_hours: int) -> DataFrame:
    """Per hour of the last ``window_hours`` before the anchor: earliest time,
    mean CO2 and the hour's newest reading.  The newest reading overall has
    ts = anchor, so it is the newest of these hours' newest readings."""
    a = t.anchor(as_of)
    order = F.struct("ts", "id")
    return (since(t.env, a - hours(window_hours)).groupBy(hour_bucket("ts").alias("b"))
            .agg(F.min("ts").alias("first_ts"), F.avg("co2").alias("co2"),
                 F.max_by(F.struct("co2", "voc"), order).alias("last"), F.max(order).alias("last_key")))


def _history(points: int):
    newest = F.slice(F.sort_array(F.collect_list(F.struct("first_ts", "co2")), asc=False), 1, points)
    return F.transform(F.reverse(newest), lambda x: F.round(F.coalesce(x["co2"], F.lit(0.0)), 0))


def co2_history(t: Tables, *, as_of=None, points: int = 6, window_hours: int = 6):
    """Hourly mean CO2 of the last 6 hours before the anchor, newest
    6 buckets (a 6-hour window can touch 7), oldest first, rounded to units.
    Returns a scalar Column (array<double>)."""
    return _recent_window(t, as_of, window_hours).agg(_history(points).alias("h")).scalar()


def _reading_and_history(t: Tables, as_of, points: int = 6, window_hours: int = 6):
    """One scan of the 6-hour window gives both the CO2 history and the newest
    reading (co2, voc): a scalar subquery returning struct(h, r)."""
    w = _recent_window(t, as_of, window_hours)
    one = w.agg(_history(points).alias("h"), F.max_by("last", "last_key").alias("r"))
    return one.select(F.struct("h", "r").alias("s")).scalar()


def sector_heatmap(t: Tables, *, as_of=None) -> DataFrame:
    """Q07: one tile per active sector.

    people      latest occupancy reading of any sensor of the sector (ts, id)
    co2 / voc   latest environment reading overall, same for every tile (C17)
    status      fixed-limit status of that reading
    alerts_24h  alerts of the sector fired in the day before the anchor
    co2_history 6-point hourly CO2 history (array, oldest first)
    """
    a = t.anchor(as_of)
    sensor_sector = t.sensor_sector().select("sensor_id", "sector_id")
    # newest per sensor first, so raw readings never meet the dimension; then newest of a sector's sensors
    of_sensor = latest(t.occ_newest(), ["sensor_id"], ["ts", "id", "people"]).select("sensor_id", "r.*")
    people = latest(of_sensor.join(sensor_sector, "sensor_id"), ["sector_id"], ["people"])
    # keys limited to existing sectors (broadcast semi-join on the checked
    # dimension), so the aggregate is provably at most one row per sector
    alerts = (since(t.alerts, a - days(1), ts="fired_at").groupBy("sector_id").agg(F.count(F.lit(1)).alias("alerts_24h"))
              .join(t.dim("sectors").select("sector_id"), "sector_id", "left_semi"))
    # both are one row per sector at most: bounded by the checked dimensions
    small = t.is_small("sensors") and t.is_small("sectors")
    recent = _reading_and_history(t, as_of)
    sec = t.sectors.where(F.col("active") == 1).select("sector_id", "sector_name", "sector_type", "max_capacity")
    tiles = (sec.join(maybe_broadcast(people, small), "sector_id", "left")
             .join(maybe_broadcast(alerts, small), "sector_id", "left"))
    # each scalar subquery is projected once; the columns below only read
    # its attribute (a subquery is not "cheap", so the projections stay apart)
    staged = tiles.select("*", recent.alias("_recent"))
    co2, voc = F.col("_recent.r.co2"), F.col("_recent.r.voc")
    n_alerts = F.coalesce("alerts_24h", F.lit(0)).cast("bigint")
    out = staged.select(
        "sector_id", "sector_name", "sector_type", "max_capacity",
        F.coalesce(F.col("r.people"), F.lit(0)).cast("int").alias("people"),
        F.round(F.coalesce(co2, F.lit(0.0)), 0).alias("co2"),
        F.round(F.coalesce(voc, F.lit(0.0)), 0).alias("voc"),
        status_fixed(co2, voc).alias("status"), n_alerts.alias("alerts_24h"),
        F.coalesce(F.col("_recent.h"), F.array().cast("array<double>")).alias("co2_history"),
        tile_text(n_alerts).alias("tile_text"))
    return out.withColumn("status_label", status_text("status")).select(
        "sector_id", "sector_name", "sector_type", "max_capacity", "people", "co2", "voc", "status",
        "alerts_24h", "co2_history", "status_label", "tile_text")
