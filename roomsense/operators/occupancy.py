"""Occupancy reports: Q03, Q04, Q12, Q15, Q19.

The reference picks "the" people counter of a sector with LIMIT 1 and no
ORDER BY; here it is the lowest HPD2 sensor id of the sector (C6), inactive
sensors included (C18).  ``sector_id=None`` answers every sector at once
(one row set per sector) instead of looping over sectors (C9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomsense.functions import (NO_MOVEMENT_TEXT, event_text, hhmm, hhmmss, minute_bucket, occupancy_band,
                                 occupancy_label, occupancy_pct)
from roomsense.plans.joins import maybe_broadcast
from roomsense.plans.latest import last_n, latest
from roomsense.plans.windows import between, ntz, since
from roomsense.tables import Tables

DEFAULT_CAPACITY = 25  # capacity used when the sector does not exist (C14)


def counter_sensor(t: Tables, sector_id: int | None = None) -> DataFrame:
    """sector_id -> its people counter (lowest HPD2 id).  One row per sector,
    bounded by the sensors dimension."""
    s = t.sensors.where(F.col("sensor_type") == "HPD2")
    if sector_id is not None:
        s = s.where(F.col("sector_id") == F.lit(sector_id))
    picked = s.groupBy("sector_id").agg(F.min("sensor_id").alias("sensor_id"))
    return maybe_broadcast(picked, t.is_small("sensors"))


def _requested_sectors(t: Tables, sector_id: int | None) -> DataFrame:
    """Sectors to answer for; a requested id that does not exist still gets a
    row, with the default capacity 25 (C14)."""
    sec = t.sectors.select("sector_id", "max_capacity")
    if sector_id is None:
        return sec.select("sector_id", "max_capacity", F.lit(True).alias("_known"))
    spark: SparkSession = t.sectors.sparkSession
    req = spark.createDataFrame([(sector_id,)], T.StructType([T.StructField("sector_id", T.LongType())]))
    j = req.join(sec.where(F.col("sector_id") == F.lit(sector_id)).withColumn("_known", F.lit(True)),
                 "sector_id", "left")
    return j.select("sector_id",
                    F.when(F.col("_known").isNull(), F.lit(DEFAULT_CAPACITY)).otherwise(
                        F.col("max_capacity")).cast("int").alias("max_capacity"),
                    F.coalesce("_known", F.lit(False)).alias("_known"))


def _counter_readings(t: Tables, sector_id: int | None, depth: int = 1) -> DataFrame:
    """Readings of the counters: the recent snapshot when it is deep enough."""
    pick = counter_sensor(t, sector_id)
    return t.occ_newest(depth).select("id", "ts", "sensor_id", "people", "delta_s").join(pick, "sensor_id", "inner")


def occupancy_now(t: Tables, sector_id: int | None = None) -> DataFrame:
    """Q03: latest people count of the sector's counter, capacity, % (+ V03
    band).  No counter -> 0 people, 0.0 %, '--'; NULL/0 capacity -> NULL %."""
    pick = counter_sensor(t, sector_id)
    reads = _counter_readings(t, sector_id)
    last = latest(reads, ["sector_id"], ["people", "ts"])
    base = _requested_sectors(t, sector_id).join(pick, "sector_id", "left").join(last, "sector_id", "left")
    has_sensor = F.col("sensor_id").isNotNull()
    people = F.when(has_sensor, F.coalesce(F.col("r.people"), F.lit(0))).otherwise(F.lit(0)).cast("int")
    pct = F.when(has_sensor, occupancy_pct(people, F.col("max_capacity"))).otherwise(F.lit(0.0))
    out = base.select("sector_id", people.alias("people"), "max_capacity", pct.alias("occupancy_pct"),
                      F.coalesce(hhmm("r.ts"), F.lit("--")).alias("reading_time"))
    return out.withColumn("band", occupancy_band("occupancy_pct"))


def occupancy_history(t: Tables, sector_id: int | None = None, n: int = 20) -> DataFrame:
    """Q04: the last ``n`` readings of the sector's counter, oldest first;
    ``recency`` 1 is the newest."""
    ranked = last_n(_counter_readings(t, sector_id, n), ["sensor_id"], n)
    return ranked.select("sector_id", "sensor_id", "recency", "people", "delta_s",
                         hhmm("ts").alias("time_label"), "ts").orderBy("sector_id", "ts", "recency")


def occupancy_events(t: Tables, sector_id: int | None = None, readings: int = 12, keep: int = 6) -> DataFrame:
    """Q12: entry/exit events of the sector's counter.

    The last 12 readings are cut first (C21), then each reading is compared
    with the one before it; non-zero changes only, newest 6.  ALERTA when the
    count reaches 80 % of capacity.  A counter whose readings show no change
    gets one "no movement" row.  All windows share the sensor partitioning, so
    the whole report is one shuffle of at most 12 rows per sensor and map task.
    """
    caps = _requested_sectors(t, sector_id).select("sector_id", "max_capacity", F.lit(True).alias("_listed"))
    cut = last_n(_counter_readings(t, sector_id, readings), ["sensor_id"], readings, rank="rn")
    # a sector that does not exist counts with the default capacity, whether asked for alone or with all others
    cut = cut.join(caps, "sector_id", "left").withColumn(
        "max_capacity", F.when(F.col("_listed").isNull(), F.lit(DEFAULT_CAPACITY)).otherwise(F.col("max_capacity")))
    w = Window.partitionBy("sensor_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    change = F.col("people") - F.lead("people").over(w)
    flagged = cut.withColumn("change", change.cast("int"))
    moved = F.coalesce(F.col("change") != 0, F.lit(False))
    flagged = flagged.withColumn("moved", moved)
    run = Window.partitionBy("sensor_id").orderBy(F.col("ts").desc(), F.col("id").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    flagged = (flagged
               .withColumn("pos", F.sum(F.col("moved").cast("int")).over(run))
               .withColumn("moves", F.sum(F.col("moved").cast("int")).over(Window.partitionBy("sensor_id"))))
    events = flagged.where((F.col("moved") & (F.col("pos") <= keep)) | ((F.col("moves") == 0) & (F.col("rn") == 1)))
    alert = F.col("moved") & (F.col("people") >= F.col("max_capacity") * F.lit(0.8))
    return events.select(
        "sector_id", "sensor_id",
        F.when(F.col("moved"), F.col("pos")).otherwise(F.lit(1)).cast("int").alias("pos"),
        hhmmss("ts").alias("event_time"), "ts",
        F.when(F.col("moved"), F.col("change")).otherwise(F.lit(0)).alias("change"),
        "people",
        F.when(F.col("moved"), event_text("change")).otherwise(F.lit(NO_MOVEMENT_TEXT)).alias("event"),
        occupancy_label("people", "max_capacity").alias("occupancy_label"),
        F.when(alert, F.lit("ALERTA")).otherwise(F.lit("NORMAL")).alias("status"),
    )


def co2_people_by_minute(t: Tables, sector_id: int | None = None, start=None, end=None) -> DataFrame:
    """Q15: mean CO2 and mean people per (sector, minute) where both were read.
    Both facts go tagged through one aggregate per (sensor, minute), combined
    map-side; only its rows meet the dimension and are folded to sectors.  One
    fact shuffle, no join of aggregates.  ``start`` / ``end`` (optional, both
    ends closed, F05) bound the readings and prune day partitions; without
    them the whole history is used, as in the reference's report."""
    ss = t.sensor_sector().select("sensor_id", "sector_id")
    if sector_id is not None:
        ss = ss.where(F.col("sector_id") == F.lit(sector_id))

    def bounded(df: DataFrame) -> DataFrame:
        if start is not None and end is not None:
            return between(df, ntz(start), ntz(end))
        if start is not None:
            return since(df, ntz(start))
        if end is not None:
            return between(df, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), ntz(end))
        return df

    none = F.lit(None).cast("double")
    both = bounded(t.env).select("sensor_id", minute_bucket("ts").alias("minute"), F.col("co2").cast("double").alias("co2"), none.alias("people"))
    both = both.unionByName(bounded(t.occ).select("sensor_id", minute_bucket("ts").alias("minute"), none.alias("co2"),
                                                  F.col("people").cast("double").alias("people")))
    parts = [f(c).alias(f"{n}_{c}") for c in ("co2", "people") for n, f in (("sum", F.sum), ("n", F.count))]
    of_sensor = both.groupBy("sensor_id", "minute").agg(*parts)
    of_sector = of_sensor.join(ss, "sensor_id").groupBy("sector_id", "minute").agg(*(F.sum(f"{n}_{c}").alias(f"{n}_{c}") for c in ("co2", "people") for n in ("sum", "n")))
    return of_sector.where("n_co2 > 0 and n_people > 0").select(
        "sector_id", "minute", *(F.round(F.col(f"sum_{c}") / F.col(f"n_{c}"), 2).alias(f"{c}_avg") for c in ("co2", "people")))


def over_capacity(t: Tables) -> DataFrame:
    """Q19: occupancy readings above their sector's capacity (F09).  A map-only
    plan: the fact streams past the broadcast sensor->sector dimension."""
    ss = t.sensor_sector().select("sensor_id", "sector_id", "sector_name", "max_capacity")
    j = t.occ.select("id", "ts", "sensor_id", "people").join(ss, "sensor_id")
    return j.where(F.col("people") > F.col("max_capacity")).select(
        "sector_id", "sector_name", "sensor_id", F.col("id").alias("reading_id"), "ts", "people")
