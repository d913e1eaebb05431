"""Data-quality reports: Q17 (orphans), Q20 (row counts), I10 (constraint
checks of the declared schema as one report)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.tables import Tables

# The allowed alert status and severity words.
ALERT_STATUSES = ["ABERTO", "EM_ATENDIMENTO", "RESOLVIDO"]
ALERT_SEVERITIES = ["CRITICO", "ATENCAO"]


def orphan_sensors(t: Tables) -> DataFrame:
    """Q17: sensors whose sector does not exist (J05, anti-join)."""
    return t.sensors.join(t.dim("sectors").select("sector_id"), "sector_id", "left_anti").select(
        "sensor_id", "sensor_type", "sector_id")


def rows_per_sensor(t: Tables) -> DataFrame:
    """Q20: readings per sensor in both telemetry tables (map-side combined)."""
    env = t.env.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("env_readings").alias("table_name"), "sensor_id", "rows")
    occ = t.occ.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("occupancy_readings").alias("table_name"), "sensor_id", "rows")
    return env.unionByName(occ)


def table_counts(t: Tables) -> DataFrame:
    """Q20: row count of every table."""
    parts = [
        getattr(t, attr).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for attr, name in [("sectors", "sectors"), ("sensors", "sensors"), ("env", "env_readings"),
                           ("occ", "occupancy_readings"), ("thresholds", "thresholds"), ("alerts", "alerts")]]
    return reduce(DataFrame.unionByName, parts)


def _fact_checks(t: Tables, fact: DataFrame, table: str, required: list[str]) -> DataFrame:
    """One scan of a telemetry fact: NOT NULL and FK flags per row, then one
    grouping-sets aggregate for both unique keys (id) and (sensor_id, ts) plus
    the global totals.  Duplicate groups are pre-aggregated map-side, so a key
    copied a billion times costs one partial row per task."""
    known = t.dim("sensors").select("sensor_id", F.lit(1).alias("_known"))
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    rows = fact.select(*required).join(known, "sensor_id", "left").select(
        "id", "sensor_id", "ts", nulls.cast("int").alias("_null"), F.col("_known").isNull().cast("int").alias("_fk"))
    g = rows.groupingSets([["id"], ["sensor_id", "ts"], []], "id", "sensor_id", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_null").alias("nulls"), F.sum("_fk").alias("fk"),
        F.grouping_id().alias("gid"))
    # gid: (id) -> 3 (sensor_id, ts grouped out), (sensor_id, ts) -> 4, () -> 7
    dup = F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.lit(0))
    s = g.agg(
        F.sum(F.when(F.col("gid") == 7, F.col("nulls"))).alias("not_null"),
        F.sum(F.when(F.col("gid") == 7, F.col("fk"))).alias("fk_sensor"),
        F.sum(F.when(F.col("gid") == 3, dup)).alias("unique_id"),
        F.sum(F.when(F.col("gid") == 4, dup)).alias("unique_sensor_ts"))
    return s.select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("check"),
                 F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations"))
        for c in ["not_null", "fk_sensor", "unique_id", "unique_sensor_ts"]])))


def _checks_one_pass(rows: DataFrame, table: str, key: str, flags: list[str]) -> DataFrame:
    """Per-row 0/1 flags plus the uniqueness of ``key`` from one scan:
    grouping sets (key) and () over the flagged rows."""
    g = rows.groupingSets([[key], []], key).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in flags], F.grouping_id().alias("gid"))
    dup = F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.lit(0))
    s = g.agg(F.sum(F.when(F.col("gid") == 0, dup)).alias("unique_id"),
              *[F.sum(F.when(F.col("gid") == 1, F.col(f))).alias(f) for f in flags])
    return s.select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("check"),
                 F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations"))
        for c in ["unique_id", *flags]])))


def _dim_checks(t: Tables) -> list[DataFrame]:
    sectors = t.dim("sectors").select("sector_id", F.lit(1).alias("_sec"))
    sensors = t.dim("sensors").select("sensor_id", F.lit(1).alias("_sen"))
    sec_dup = _checks_one_pass(t.sectors.select("sector_id"), "sectors", "sector_id", [])
    sen = t.sensors.select("sensor_id", "sector_id").join(sectors, "sector_id", "left").select(
        "sensor_id", F.col("_sec").isNull().cast("int").alias("fk_sector"))
    al = (t.alerts.select("alert_id", "sector_id", "sensor_id", "status", "severity")
          .join(sectors, "sector_id", "left").join(sensors, "sensor_id", "left")
          .select("alert_id",
                  F.col("_sec").isNull().cast("int").alias("fk_sector"),
                  F.col("_sen").isNull().cast("int").alias("fk_sensor"),
                  (~F.col("status").isin(*ALERT_STATUSES)).cast("int").alias("domain_status"),
                  (~F.col("severity").isin(*ALERT_SEVERITIES)).cast("int").alias("domain_severity")))
    return [
        sec_dup,
        _checks_one_pass(sen, "sensors", "sensor_id", ["fk_sector"]),
        _checks_one_pass(al, "alerts", "alert_id", ["fk_sector", "fk_sensor", "domain_status", "domain_severity"]),
    ]


ENV_REQUIRED = ["id", "ts", "sensor_id", "delta_s", "luminosity", "humidity", "temperature", "voc", "co2",
                "pressure", "noise", "aerosol_still", "aerosol_risk", "dew_point"]
OCC_REQUIRED = ["id", "ts", "sensor_id", "delta_s", "people", "luminosity", "humidity", "temperature"]


def dq_report(t: Tables) -> DataFrame:
    """NOT NULL, FK, UNIQUE and domain checks as (table, check, violations)."""
    parts = [_fact_checks(t, t.env, "env_readings", ENV_REQUIRED),
             _fact_checks(t, t.occ, "occupancy_readings", OCC_REQUIRED)] + _dim_checks(t)
    return reduce(DataFrame.unionByName, parts)
