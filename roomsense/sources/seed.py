"""Reference-data seed (S06): sectors, sensors, thresholds and sample alerts.

Alert times are given as minutes before a caller-chosen ``as_of`` so the seed
works as a fixed-time fixture.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from roomsense import schemas

# The seed rows.
SECTOR_ROWS = [
    (1, "UTI Adulto - Ala A", "UTI", "3", 10, 1),
    (2, "Sala de Espera - Triagem", "Recepção", "1", 30, 1),
    (3, "Enfermaria - Ala B", "Enfermaria", "2", 20, 1),
    (4, "Centro Cirúrgico 02", "Cirurgia", "2", 8, 1),
    (5, "Farmácia Central", "Farmácia", "1", 15, 1),
]

SENSOR_ROWS = [
    (1, "CREATIVE-01", "MULTISENSOR", 1),
    (2, "HPD2-ENFA-B", "HPD2", 3),
    (3, "HPD2-UTI-A", "HPD2", 1),
    (6, "HPD2-TRIAG", "HPD2", 2),
    (7, "HPD2-FARM", "HPD2", 5),
    (8, "HPD2-CC02", "HPD2", 4),
]

# (sector_type, parameter, critical, attention, unit); both seed blocks, in
# order, then one row of ours with no attention tier.
THRESHOLD_ROWS = [
    ("Geral", "CO2", 1000.0, 800.0, "ppm"),
    ("Geral", "VOC", 400.0, 250.0, "ppb"),
    ("Geral", "TEMPERATURA", 26.0, 24.0, "°C"),
    ("Geral", "UMIDADE", 70.0, 60.0, "%"),
    ("Geral", "RUIDO", 70.0, 55.0, "dB"),
    ("UTI", "CO2", 800.0, 600.0, "ppm"),
    ("UTI", "TEMPERATURA", 24.0, 22.0, "°C"),
    ("UTI", "UMIDADE", 60.0, 50.0, "%"),
    ("UTI", "RUIDO", 55.0, 45.0, "dB"),
    ("Cirurgia", "CO2", 700.0, 500.0, "ppm"),
    ("Cirurgia", "TEMPERATURA", 22.0, 20.0, "°C"),
    ("Cirurgia", "RUIDO", 50.0, 40.0, "dB"),
    ("Recepção", "CO2", 1200.0, 900.0, "ppm"),
    ("Recepção", "RUIDO", 75.0, 65.0, "dB"),
    ("Geral", "CO2", 1000.0, 800.0, "ppm"),
    ("Geral", "VOC", 400.0, 250.0, "ppb"),
    ("Geral", "TEMPERATURA", 26.0, 24.0, "°C"),
    ("Geral", "RUIDO", 70.0, 55.0, "dB"),
    ("UTI", "CO2", 800.0, 600.0, "ppm"),
    ("Enfermaria", "UMIDADE", 70.0, 60.0, "%"),
    ("Farmácia", "VOC", 350.0, None, "ppb"),
]

# (alert_id, sensor, sector, parameter, measured, limit, unit, severity, status,
#  fired / attended / normalised as minutes before as_of)
ALERT_ROWS = [
    (1, 3, 1, "CO2", 1150.5, 1000.0, "ppm", "CRITICO", "RESOLVIDO", 120, 115, 90),
    (2, 1, 1, "TEMPERATURA", 26.8, 24.0, "°C", "CRITICO", "EM_ATENDIMENTO", 45, 37, None),
    (3, 6, 2, "RUIDO", 82.0, 75.0, "dB", "CRITICO", "ABERTO", 25, None, None),
    (4, 1, 3, "VOC", 310.0, 250.0, "ppb", "ATENCAO", "RESOLVIDO", 180, 155, 120),
    (5, 7, 5, "CO2", 870.0, 800.0, "ppm", "ATENCAO", "ABERTO", 8, None, None),
    (6, 6, 2, "PESSOAS", 33.0, 30.0, "pessoas", "CRITICO", "EM_ATENDIMENTO", 15, 10, None),
]
ALERT_ROWS_SECOND_BLOCK = [
    (7, 1, 1, "CO2", 1150.5, 1000.0, "ppm", "CRITICO", "RESOLVIDO", 120, 115, 30),
    (8, 1, 1, "TEMPERATURA", 28.2, 26.0, "°C", "CRITICO", "EM_ATENDIMENTO", 45, 40, None),
    (9, 3, 1, "RUIDO", 62.0, 55.0, "dB", "ATENCAO", "ABERTO", 10, None, None),
]

INSTALLED_AT = dt.datetime(2025, 1, 1)


def sectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTOR_ROWS, schemas.SECTORS)


def sensors(spark: SparkSession) -> DataFrame:
    rows = [(i, c, t, s, INSTALLED_AT, 1) for i, c, t, s in SENSOR_ROWS]
    return spark.createDataFrame(rows, schemas.SENSORS)


def thresholds(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *r) for i, r in enumerate(THRESHOLD_ROWS)]
    return spark.createDataFrame(rows, schemas.THRESHOLDS)


def alerts(spark: SparkSession, as_of: dt.datetime, second_block: bool = False) -> DataFrame:
    def back(m):
        return None if m is None else as_of - dt.timedelta(minutes=m)

    rows = ALERT_ROWS + (ALERT_ROWS_SECOND_BLOCK if second_block else [])
    out = [(a, sn, sc, p, v, lim, u, sev, st, back(f), back(at), back(nm), f"alerta {a}")
           for a, sn, sc, p, v, lim, u, sev, st, f, at, nm in rows]
    return spark.createDataFrame(out, schemas.ALERTS)
