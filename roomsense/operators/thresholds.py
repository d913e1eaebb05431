"""Per-type limits: Q21 (lookup with fallback), Q22 (status from limits) and
the alert-raising extension I12.

The thresholds table has no unique key on (type, parameter) (the seed repeats
rows), so it is first reduced to one row per key (lowest threshold_id).  The
fallback is then two equi left joins — specific type, and 'Geral' — and a
row-level choice, so a NULL attention limit of the chosen row is kept, not
filled from another row (C16).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.functions import CRITICAL, ATTENTION, status_by_limits
from roomsense.plans.joins import maybe_broadcast
from roomsense.plans.latest import latest
from roomsense.tables import Tables

# The general sector type, the default limits when no row
# applies, and the parameters a sector is looked up for.
GENERAL_TYPE = "Geral"
DEFAULT_LIMIT = 9999.0
LOOKUP_PARAMETERS = ["CO2", "VOC", "TEMPERATURA", "UMIDADE", "RUIDO", "PESSOAS"]
READING_PARAMETERS = [("CO2", "co2"), ("VOC", "voc"), ("TEMPERATURA", "temperature"),
                      ("UMIDADE", "humidity"), ("RUIDO", "noise")]


def unique_limits(t: Tables) -> DataFrame:
    lim = F.struct("critical_limit", "attention_limit", "unit")
    u = t.thresholds.groupBy("sector_type", "parameter").agg(F.min_by(lim, "threshold_id").alias("lim"))
    return maybe_broadcast(u, t.is_small("thresholds"))


def resolve_limits(t: Tables, requests: DataFrame) -> DataFrame:
    """Q21 set-oriented: for each (sector_type, parameter) request row, the
    specific limits, else the 'Geral' ones, else 9999/9999."""
    u = unique_limits(t)
    spec = u.select(F.col("sector_type"), F.col("parameter"), F.col("lim").alias("spec"))
    gen = u.where(F.col("sector_type") == GENERAL_TYPE).select(F.col("parameter"), F.col("lim").alias("gen"))
    j = requests.join(spec, ["sector_type", "parameter"], "left").join(gen, ["parameter"], "left")
    chosen = F.when(F.col("spec").isNotNull(), F.col("spec")).when(F.col("gen").isNotNull(), F.col("gen"))
    src = (F.when(F.col("spec").isNotNull(), F.lit("specific")).when(F.col("gen").isNotNull(), F.lit(GENERAL_TYPE))
           .otherwise(F.lit("default")))
    return j.select(
        *[c for c in requests.columns],
        F.coalesce(chosen.getField("critical_limit"), F.when(chosen.isNull(), F.lit(DEFAULT_LIMIT))).alias(
            "critical_limit"),
        F.when(chosen.isNull(), F.lit(DEFAULT_LIMIT)).otherwise(chosen.getField("attention_limit")).alias(
            "attention_limit"),
        chosen.getField("unit").alias("unit"),
        src.alias("limit_source"))


def threshold_lookup(t: Tables) -> DataFrame:
    """Q21 for every sector and parameter."""
    req = t.sectors.select("sector_id", "sector_type",
                           F.explode(F.array(*[F.lit(p) for p in LOOKUP_PARAMETERS])).alias("parameter"))
    return resolve_limits(t, req).select("sector_id", "sector_type", "parameter", "critical_limit",
                                         "attention_limit", "limit_source")


def _type_limits(t: Tables) -> DataFrame:
    """(sector_type, parameter) -> limits for every sector type in use; at most
    #types x #parameters rows."""
    types = t.sectors.select("sector_type").distinct()
    req = types.select("sector_type", F.explode(F.array(*[F.lit(p) for p, _ in READING_PARAMETERS])).alias(
        "parameter"))
    return resolve_limits(t, req)


def status_by_threshold(t: Tables) -> DataFrame:
    """Q22 on Q14's rows: latest reading per sensor, status from its sector
    type's CO2 and VOC limits (strict '>', NULL tier absent)."""
    r = latest(t.env_newest(), ["sensor_id"], ["ts", "co2", "voc"])
    j = r.join(t.sensor_sector().select("sensor_id", "sector_id", "sector_type"), "sensor_id")
    lim = _type_limits(t).where(F.col("parameter").isin("CO2", "VOC"))
    wide = lim.groupBy("sector_type").agg(
        F.max(F.when(F.col("parameter") == "CO2", F.struct("critical_limit", "attention_limit"))).alias("c"),
        F.max(F.when(F.col("parameter") == "VOC", F.struct("critical_limit", "attention_limit"))).alias("v"))
    small = t.is_small("sectors") and t.is_small("thresholds")
    j = j.join(maybe_broadcast(wide, small), "sector_type", "left")
    return j.select(
        "sensor_id", "sector_id", "sector_type", F.col("r.ts").alias("ts"), F.col("r.co2").alias("co2"),
        F.col("r.voc").alias("voc"),
        F.col("c.critical_limit").alias("co2_critical"), F.col("c.attention_limit").alias("co2_attention"),
        F.col("v.critical_limit").alias("voc_critical"), F.col("v.attention_limit").alias("voc_attention"),
        status_by_limits("r.co2", "r.voc", "c.critical_limit", "c.attention_limit", "v.critical_limit",
                         "v.attention_limit").alias("status"))


def alerts_from_thresholds(t: Tables, readings: DataFrame | None = None) -> DataFrame:
    """I12 (extension; the reference declares it but never built it): every
    reading unpivoted to (parameter, value), limits of its sector type, and an
    alert-shaped row when a limit is crossed.  Stateless per row, so the same
    function serves batch and stream."""
    env = t.env if readings is None else readings
    # one row of limits per sector type, joined before the parameters are unfolded; only crossings are unfolded
    lim = _type_limits(t).groupBy("sector_type").agg(F.map_from_entries(F.collect_list(F.struct(
        "parameter", F.struct("critical_limit", "attention_limit", "unit")))).alias("limits"))
    small = t.is_small("sectors") and t.is_small("thresholds")
    ss = t.sensor_sector().select("sensor_id", "sector_id", "sector_type")
    j = env.join(ss, "sensor_id").join(maybe_broadcast(lim, small), "sector_type")
    pairs = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(c).alias("measured"), F.col("limits")[p].alias("lim"))
                      for p, c in READING_PARAMETERS])
    crossed = F.filter(pairs, lambda x: F.coalesce((x["measured"] > x["lim"]["critical_limit"])
                                                   | (x["measured"] > x["lim"]["attention_limit"]), F.lit(False)))
    long = j.select("id", "ts", "sensor_id", "sector_id", F.inline(crossed))
    hit = long.select("id", "ts", "sensor_id", "sector_id", "parameter", "measured", "lim.*").withColumn(
        "severity", F.when(F.col("measured") > F.col("critical_limit"), F.lit(CRITICAL)).otherwise(F.lit(ATTENTION)))
    return hit.select(
        F.col("id").alias("reading_id"), "sensor_id", "sector_id", "parameter", "measured",
        F.when(F.col("severity") == CRITICAL, F.col("critical_limit")).otherwise(F.col("attention_limit")).alias(
            "limit_ref"),
        "unit", "severity", F.lit("ABERTO").alias("status"), F.col("ts").alias("fired_at"))
