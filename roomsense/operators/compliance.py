"""Q13: regulatory compliance — % of readings inside the limits and the
maximum for five parameters, plus the mean of the five rounded percentages
(A14).  One aggregate pass, then a 1-row -> 5-row unpivot (P09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.plans.windows import as_of_col, days, period_days, since
from roomsense.tables import Tables

# Fixed values: (label, standard max, unit, rounding of the max) per parameter,
# in report order, and the compliance ranges: CO2 <= 1000, VOC <= 400,
# 18 <= temperature <= 26, 30 <= humidity <= 70, noise <= 70; pass mark 95 %,
# green bar from 90 %.
PARAMETERS = [
    ("CO2", 1000, "ppm", 0),
    ("VOC", 400, "ppb", 0),
    ("Temperatura", 26, "°C", 1),
    ("Umidade", 70, "%", 1),
    ("Ruído", 70, "dB", 0),
]
PASS_MARK, BAR_OK = 95.0, 90.0


def compliance(t: Tables, period: str = "24h", *, as_of=None) -> DataFrame:
    rows = since(t.env, as_of_col(as_of) - days(period_days(period)))
    checks = [
        F.col("co2") <= 1000,
        F.col("voc") <= 400,
        F.col("temperature").between(18, 26),
        F.col("humidity").between(30, 70),
        F.col("noise") <= 70,
    ]
    source = ["co2", "voc", "temperature", "humidity", "noise"]
    g = rows.select(*source).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(c).alias(f"ok{i}") for i, c in enumerate(checks)],
        *[F.max(c).alias(f"max{i}") for i, c in enumerate(source)])
    total = F.when(F.col("total") == 0, F.lit(1)).otherwise(F.col("total"))
    pcts = [F.round(F.col(f"ok{i}") / total * F.lit(100.0), 1) for i in range(len(PARAMETERS))]
    wide = g.select(*[p.alias(f"pct{i}") for i, p in enumerate(pcts)],
                    *[F.round(F.coalesce(F.col(f"max{i}"), F.lit(0.0)), PARAMETERS[i][3]).alias(f"max{i}")
                      for i in range(len(PARAMETERS))])
    global_pct = F.round(sum((F.col(f"pct{i}") for i in range(len(PARAMETERS))), F.lit(0.0)) / len(PARAMETERS), 1)
    items = F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("parameter"),
                 F.lit(std).alias("standard_max"), F.lit(unit).alias("unit"),
                 F.col(f"pct{i}").alias("compliance_pct"), F.col(f"max{i}").alias("max_value"))
        for i, (label, std, unit, _) in enumerate(PARAMETERS)])
    long = wide.select(global_pct.alias("global_pct"), F.inline(items))
    return long.select(
        "position", "parameter", "standard_max", "unit", "compliance_pct", "max_value", "global_pct",
        (F.col("compliance_pct") >= PASS_MARK).alias("meets_standard"),
        (F.col("compliance_pct") >= BAR_OK).alias("bar_ok"))
