"""Declared schemas of the six tables and of the landed telemetry feed."""

from pyspark.sql import types as T

SECTORS = T.StructType([
    T.StructField("sector_id", T.LongType(), False),
    T.StructField("sector_name", T.StringType(), False),
    T.StructField("sector_type", T.StringType(), False),
    T.StructField("floor", T.StringType(), True),
    T.StructField("max_capacity", T.IntegerType(), True),
    T.StructField("active", T.IntegerType(), True),
])

SENSORS = T.StructType([
    T.StructField("sensor_id", T.LongType(), False),
    T.StructField("sensor_code", T.StringType(), False),
    T.StructField("sensor_type", T.StringType(), False),
    T.StructField("sector_id", T.LongType(), False),
    T.StructField("installed_at", T.TimestampNTZType(), False),
    T.StructField("active", T.IntegerType(), True),
])

ENV_READINGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("sensor_id", T.LongType(), False),
    T.StructField("delta_s", T.IntegerType(), False),
    T.StructField("luminosity", T.DoubleType(), False),
    T.StructField("humidity", T.DoubleType(), False),
    T.StructField("temperature", T.DoubleType(), False),
    T.StructField("voc", T.DoubleType(), False),
    T.StructField("co2", T.DoubleType(), False),
    T.StructField("pressure", T.DoubleType(), False),
    T.StructField("noise", T.DoubleType(), False),
    T.StructField("aerosol_still", T.IntegerType(), False),
    T.StructField("aerosol_risk", T.IntegerType(), False),
    T.StructField("dew_point", T.DoubleType(), False),
])

OCCUPANCY_READINGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("sensor_id", T.LongType(), False),
    T.StructField("delta_s", T.IntegerType(), False),
    T.StructField("people", T.IntegerType(), False),
    T.StructField("luminosity", T.DoubleType(), False),
    T.StructField("humidity", T.DoubleType(), False),
    T.StructField("temperature", T.DoubleType(), False),
])

THRESHOLDS = T.StructType([
    T.StructField("threshold_id", T.LongType(), False),
    T.StructField("sector_type", T.StringType(), False),
    T.StructField("parameter", T.StringType(), False),
    T.StructField("critical_limit", T.DoubleType(), False),
    T.StructField("attention_limit", T.DoubleType(), True),
    T.StructField("unit", T.StringType(), False),
])

ALERTS = T.StructType([
    T.StructField("alert_id", T.LongType(), False),
    T.StructField("sensor_id", T.LongType(), False),
    T.StructField("sector_id", T.LongType(), False),
    T.StructField("parameter", T.StringType(), False),
    T.StructField("measured", T.DoubleType(), False),
    T.StructField("limit_ref", T.DoubleType(), False),
    T.StructField("unit", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("fired_at", T.TimestampNTZType(), False),
    T.StructField("attended_at", T.TimestampNTZType(), True),
    T.StructField("normalised_at", T.TimestampNTZType(), True),
    T.StructField("description", T.StringType(), True),
])

# Landed feed records.  Fixed values: the key names of the upstream JSON
# payload, exactly as the feed delivers them (environment feed, then
# occupancy feed).  Times arrive as text and are parsed by the ingest job.
FEED_ENV = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("data", T.StringType(), True),
    T.StructField("id_sensor", T.LongType(), True),
    T.StructField("delta", T.IntegerType(), True),
    T.StructField("luminosidade", T.DoubleType(), True),
    T.StructField("umidade", T.DoubleType(), True),
    T.StructField("temperatura", T.DoubleType(), True),
    T.StructField("voc", T.DoubleType(), True),
    T.StructField("co2", T.DoubleType(), True),
    T.StructField("pressao_ar", T.DoubleType(), True),
    T.StructField("ruido", T.DoubleType(), True),
    T.StructField("aerosol_parado", T.IntegerType(), True),
    T.StructField("aerosol_risco", T.IntegerType(), True),
    T.StructField("ponto_orvalho", T.DoubleType(), True),
])

FEED_OCCUPANCY = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("data", T.StringType(), True),
    T.StructField("id_sensor", T.LongType(), True),
    T.StructField("delta", T.IntegerType(), True),
    T.StructField("pessoas", T.IntegerType(), True),
    T.StructField("luminosidade", T.DoubleType(), True),
    T.StructField("umidade", T.DoubleType(), True),
    T.StructField("temperatura", T.DoubleType(), True),
])

# feed key -> table column, per feed
FEED_ENV_COLUMNS = {
    "id": "id", "data": "ts", "id_sensor": "sensor_id", "delta": "delta_s",
    "luminosidade": "luminosity", "umidade": "humidity", "temperatura": "temperature",
    "voc": "voc", "co2": "co2", "pressao_ar": "pressure", "ruido": "noise",
    "aerosol_parado": "aerosol_still", "aerosol_risco": "aerosol_risk", "ponto_orvalho": "dew_point",
}
FEED_OCCUPANCY_COLUMNS = {
    "id": "id", "data": "ts", "id_sensor": "sensor_id", "delta": "delta_s", "pessoas": "people",
    "luminosidade": "luminosity", "umidade": "humidity", "temperatura": "temperature",
}
