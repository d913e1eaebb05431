"""Scale fixture: the six tables derived from the driver's generated tables.

``supplier`` -> sectors and sensors, ``events`` -> both telemetry tables,
``orders`` -> alerts; thresholds are the seed rows.  Every rule is a plain
column expression, so the derived tables are lazy projections of the scans
and the reports push their filters and column choices down to the parquet.
``fixture_sql.ADAPTER_CTES`` holds the same rules as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from roomsense.functions import second_floor
from roomsense.sources import seed
from roomsense.tables import Tables

# Fixed values of the adapter rules (see FIXTURES.md §3).
SECTOR_TYPES = ["UTI", "Recepção", "Enfermaria", "Cirurgia", "Farmácia"]  # by s_suppkey % 5
ALERT_PARAMETERS = ["CO2", "VOC", "TEMPERATURA", "RUIDO", "UMIDADE"]      # by priority 1..5
PARAMETER_UNITS = {"CO2": "ppm", "VOC": "ppb", "TEMPERATURA": "°C", "RUIDO": "dB", "UMIDADE": "%"}
ALERT_STATUS = {"O": "ABERTO", "P": "EM_ATENDIMENTO", "F": "RESOLVIDO"}
ALERT_EPOCH = "2024-01-01 00:00:00"
INSTALLED_AT = "2023-12-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"


def _pick(index_col, values):
    expr = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        expr = F.when(index_col == i, F.lit(values[i])).otherwise(expr)
    return expr


def build(spark: SparkSession, sf_dir: str) -> Tables:
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = sup.select(F.count(F.lit(1))).scalar()
    s = F.col("s_suppkey")

    sectors = sup.select(
        (s + 1).alias("sector_id"),
        F.col("s_name").alias("sector_name"),
        _pick(s % 5, SECTOR_TYPES).alias("sector_type"),
        F.col("s_nationkey").cast("string").alias("floor"),
        F.when(s % 10 == 4, F.lit(None)).otherwise(8 + s % 23).cast("int").alias("max_capacity"),
        F.when(s % 10 == 9, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("active"),
    )

    installed = F.lit(INSTALLED_AT).cast("timestamp_ntz").alias("installed_at")
    multi = sup.select((2 * s + 1).alias("sensor_id"), F.concat(F.lit("MS-"), s.cast("string")).alias("sensor_code"),
                       F.lit("MULTISENSOR").alias("sensor_type"), (s + 1).alias("sector_id"), installed,
                       F.lit(1).alias("active"))
    hpd2 = sup.where(s % 10 != 8).select(
        (2 * s + 2).alias("sensor_id"), F.concat(F.lit("HPD2-"), s.cast("string")).alias("sensor_code"),
        F.lit("HPD2").alias("sensor_type"),
        F.when(s % 10 == 7, s + 1000001).otherwise(s + 1).alias("sector_id"), installed,
        F.when(s % 10 == 6, F.lit(0)).otherwise(F.lit(1)).alias("active"))
    hpd2b = sup.where(s % 10 == 5).select(
        (F.lit(10000000) + s).alias("sensor_id"), F.concat(F.lit("HPD2B-"), s.cast("string")).alias("sensor_code"),
        F.lit("HPD2").alias("sensor_type"), (s + 1).alias("sector_id"), installed, F.lit(1).alias("active"))
    sensors = multi.unionByName(hpd2).unionByName(hpd2b).withColumn("active", F.col("active").cast("int"))

    k = F.col("user_id") % n
    v = F.round(F.col("value") * 100).cast("bigint")
    ts = second_floor("ts").alias("ts")
    eid = F.col("event_id")
    env = ev.select(
        eid.alias("id"), ts, (2 * k + 1).alias("sensor_id"), F.lit(60).alias("delta_s"),
        F.lit(300.0).alias("luminosity"),
        (F.lit(25.0) + F.get_json_object("props", "$.k").cast("double") / F.lit(2.0)).alias("humidity"),
        (F.lit(16.0) + (eid % 97) / F.lit(8.0)).alias("temperature"),
        (v / F.lit(32.0)).alias("voc"),
        (F.lit(400.0) + v / F.lit(16.0)).alias("co2"),
        F.lit(1013.0).alias("pressure"),
        (F.lit(35.0) + (eid % 41).cast("double")).alias("noise"),
        F.lit(0).alias("aerosol_still"), F.lit(0).alias("aerosol_risk"), F.lit(10.0).alias("dew_point"),
    )
    occ = ev.select(
        eid.alias("id"), ts, (2 * k + 2).alias("sensor_id"), F.lit(60).alias("delta_s"),
        F.when(k % 10 == 3, F.lit(5)).otherwise((eid * 7) % 31).cast("int").alias("people"),
        F.lit(300.0).alias("luminosity"), F.lit(50.0).alias("humidity"), F.lit(22.0).alias("temperature"),
    )

    ok = F.col("o_orderkey")
    fired = F.timestamp_add("SECOND", (ok * 7919) % 2592000, F.lit(ALERT_EPOCH).cast("timestamp_ntz"))
    attended = F.when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise(
        F.timestamp_add("SECOND", ok % 1800, fired))
    normalised = F.when(F.col("o_orderstatus") == "F", F.timestamp_add("SECOND", 60 * (ok % 120), attended))
    prio = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    parameter = _pick(prio, ALERT_PARAMETERS)
    unit = _pick(prio, [PARAMETER_UNITS[p] for p in ALERT_PARAMETERS])
    status = F.when(F.col("o_orderstatus") == "O", F.lit(ALERT_STATUS["O"])).when(
        F.col("o_orderstatus") == "P", F.lit(ALERT_STATUS["P"])).otherwise(F.lit(ALERT_STATUS["F"]))
    alerts = orders.select(
        ok.alias("alert_id"), (2 * (F.col("o_custkey") % n) + 1).alias("sensor_id"),
        (F.col("o_custkey") % n + 1).alias("sector_id"), parameter.alias("parameter"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("measured"), F.lit(250.0).alias("limit_ref"),
        unit.alias("unit"),
        F.when(F.col("o_totalprice") >= 250000, F.lit("CRITICO")).otherwise(F.lit("ATENCAO")).alias("severity"),
        status.alias("status"), fired.alias("fired_at"), attended.cast("timestamp_ntz").alias("attended_at"),
        normalised.cast("timestamp_ntz").alias("normalised_at"),
        F.concat(F.lit("alerta "), ok.cast("string")).alias("description"),
    )
    return Tables(sectors=sectors, sensors=sensors, env=env, occ=occ,
                  thresholds=seed.thresholds(spark), alerts=alerts)


# ---------------------------------------------------------------- broken rows, for the constraint report

# Fixed rules of the broken fixture (``fixture_sql.broken_ctes`` holds the same): of the rows whose key leaves remainder r
# modulo m, a column becomes a value.  (table, key, m, r, column, value); None is NULL.
LONG_TEXT = "x" * 101
BREAKS = [
    ("sectors", "sector_id", 23, 1, "sector_name", None), ("sectors", "sector_id", 23, 2, "sector_type", None),
    ("sectors", "sector_id", 23, 3, "sector_name", LONG_TEXT), ("sectors", "sector_id", 23, 4, "sector_type", LONG_TEXT),
    ("sectors", "sector_id", 23, 5, "floor", LONG_TEXT), ("sectors", "sector_id", 23, 6, "active", 300),
    ("sectors", "sector_id", 23, 7, "sector_id", None), ("sectors", "sector_id", 23, 8, "sector_id", 9),
    ("sensors", "sensor_id", 29, 1, "sensor_code", None), ("sensors", "sensor_id", 29, 2, "sensor_type", None),
    ("sensors", "sensor_id", 29, 3, "sector_id", None), ("sensors", "sensor_id", 29, 4, "installed_at", None),
    ("sensors", "sensor_id", 29, 5, "sensor_code", LONG_TEXT), ("sensors", "sensor_id", 29, 6, "sensor_type", LONG_TEXT),
    ("sensors", "sensor_id", 29, 7, "active", -129), ("sensors", "sensor_id", 29, 8, "sensor_id", None),
    ("sensors", "sensor_id", 29, 9, "sensor_id", 1),
    *(("env", "id", 97, i, c, None) for i, c in enumerate(["ts", "sensor_id", "delta_s", "luminosity", "humidity", "temperature", "voc", "co2",
                                                           "pressure", "noise", "aerosol_still", "aerosol_risk", "dew_point"])),
    ("env", "id", 97, 20, "aerosol_still", 128), ("env", "id", 97, 21, "aerosol_risk", -200), ("env", "id", 97, 22, "sensor_id", 99999999),
    ("env", "id", 97, 23, "id", 5), ("env", "id", 97, 24, "id", None),
    *(("occ", "id", 89, i, c, None) for i, c in enumerate(["ts", "sensor_id", "delta_s", "people", "luminosity", "humidity", "temperature"])),
    ("occ", "id", 89, 20, "people", 400), ("occ", "id", 89, 21, "sensor_id", 99999998), ("occ", "id", 89, 22, "id", 6), ("occ", "id", 89, 23, "id", None),
    ("thresholds", "threshold_id", 11, 1, "sector_type", None), ("thresholds", "threshold_id", 11, 2, "parameter", None),
    ("thresholds", "threshold_id", 11, 3, "critical_limit", None), ("thresholds", "threshold_id", 11, 4, "unit", None),
    ("thresholds", "threshold_id", 11, 5, "unit", LONG_TEXT), ("thresholds", "threshold_id", 11, 6, "sector_type", LONG_TEXT),
    ("thresholds", "threshold_id", 11, 7, "parameter", LONG_TEXT), ("thresholds", "threshold_id", 11, 8, "threshold_id", 9),
    ("thresholds", "threshold_id", 11, 10, "threshold_id", None),
    *(("alerts", "alert_id", 83, i, c, None) for i, c in enumerate(["sensor_id", "sector_id", "parameter", "measured", "limit_ref", "unit", "severity",
                                                                    "status", "fired_at", "alert_id"])),
    ("alerts", "alert_id", 83, 20, "parameter", LONG_TEXT), ("alerts", "alert_id", 83, 21, "unit", LONG_TEXT),
    ("alerts", "alert_id", 83, 22, "severity", LONG_TEXT), ("alerts", "alert_id", 83, 23, "status", LONG_TEXT),
    ("alerts", "alert_id", 83, 24, "status", "FECHADO"), ("alerts", "alert_id", 83, 25, "severity", "LEVE"),
    ("alerts", "alert_id", 83, 26, "sensor_id", 99999997), ("alerts", "alert_id", 83, 27, "sector_id", 99999996), ("alerts", "alert_id", 83, 28, "alert_id", 7),
]
# Rows of these keys come again under another id: (table, key, m, r, added to the key).
TWINS = [("env", "id", 101, 0, 2_000_000_000), ("occ", "id", 103, 0, 2_000_000_000), ("thresholds", "threshold_id", 7, 0, 1000)]


def broken(t: Tables) -> Tables:
    """The fixture with rows that break every declared constraint."""
    frames = {}
    for table in dict.fromkeys(b[0] for b in BREAKS):
        rows = getattr(t, table)
        for name, key, m, r, add in TWINS:
            if name == table:
                rows = rows.unionByName(rows.where(F.col(key) % m == r).withColumn(key, F.col(key) + add))
        changed = {}
        for name, key, m, r, column, value in BREAKS:
            if name == table:
                now = changed.get(column, F.col(column))
                changed[column] = F.when(F.col(key) % m == r, F.lit(value).cast(rows.schema[column].dataType)).otherwise(now)
        frames[table] = rows.select(*(changed.get(c, F.col(c)).alias(c) for c in rows.columns))
    return t.replace(**frames)


# ---------------------------------------------------------------- a batch with repeated keys, and the store it meets

def repeated_batch(t: Tables, stored_before: str, arrival: str):
    """(batch, stored): a reading batch with ids and (sensor, ts) pairs that come again, in the batch and against the store.

    The same id comes later with another CO2 (id % 7 = 0), and under a larger id with the same sensor and time (id % 11 = 0);
    the store holds earlier rows, of which some stand under another id (id % 13 = 0).
    """
    env = t.env.withColumn(arrival, F.col("id"))
    later = env.where("id % 7 = 0").withColumn("co2", F.col("co2") + 1).withColumn(arrival, F.col(arrival) + 3_000_000_000)
    other = env.where("id % 11 = 0").withColumn("id", F.col("id") + 4_000_000_000).withColumn(arrival, -F.col(arrival))
    stored = t.env.where(F.col("ts") < F.lit(stored_before).cast("timestamp_ntz"))
    stored = stored.withColumn("id", F.when(F.col("id") % 13 == 0, F.col("id") + 5_000_000_000).otherwise(F.col("id")))
    return later.unionByName(env).unionByName(other), stored
