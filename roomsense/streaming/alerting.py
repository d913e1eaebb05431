"""I12 streaming form: alerts raised from a reading stream.

The per-row rule is ``operators.thresholds.alerts_from_thresholds``.
``start_store_alerts`` serves a store: every micro-batch reads the dimensions
anew, so devices registered meanwhile raise too, and appends full rows of the
alerts, which the alert reports read.  An alert's id is a hash of
its reading and parameter, and a batch adds only ids that are not there, so a
replayed batch adds nothing.  ``start_alerts`` is the plain stream-static join
over dimensions as they are at its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomsense import schemas
from roomsense.operators.thresholds import alerts_from_thresholds
from roomsense.sources import sink
from roomsense.tables import Tables


def alert_stream(t: Tables, readings_stream: DataFrame) -> DataFrame:
    return alerts_from_thresholds(t, readings=readings_stream)


def start_alerts(t: Tables, readings_stream: DataFrame, out_dir: str, checkpoint: str, available_now: bool = False,
                 period: str = "60 seconds"):
    """Append-only parquet sink partitioned by the firing day, so the alert
    reports' time windows (Q06c, Q07, Q09, Q10) prune days when reading it."""
    alerts = alert_stream(t, readings_stream).withColumn("day", F.to_date("fired_at"))
    w = (alerts.writeStream.format("parquet").option("path", out_dir).partitionBy("day")
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)
    return w.start()


def alert_rows(raised: DataFrame) -> DataFrame:
    """Raised crossings as rows of the ``alerts`` table, open and not yet attended."""
    none = F.lit(None).cast("timestamp_ntz")
    text = F.concat_ws(" ", "parameter", F.col("measured").cast("string"), F.lit(">"), F.col("limit_ref").cast("string"))
    full = raised.select(F.shiftrightunsigned(F.xxhash64("reading_id", "parameter"), 1).alias("alert_id"), "sensor_id", "sector_id", "parameter",
                         "measured", "limit_ref", F.coalesce("unit", F.lit("")).alias("unit"), "severity", "status", "fired_at",
                         none.alias("attended_at"), none.alias("normalised_at"), text.alias("description"))
    return full.select(*[f.name for f in schemas.ALERTS.fields])


def start_store_alerts(spark: SparkSession, store_root: str, readings_stream: DataFrame, checkpoint: str, available_now: bool = False,
                       period: str = "60 seconds"):
    """Raise alerts from a reading stream into the alerts of a store, by the day they fired.  A trigger opens only the days
    of its own alerts to see which are there already."""
    def write(batch: DataFrame, _batch_id: int) -> None:
        t = Tables.from_storage(spark, store_root)
        new = alert_rows(alerts_from_thresholds(t, readings=batch)).dropDuplicates(["alert_id"]).persist()
        try:
            fired = [r[0] for r in new.select(F.to_date("fired_at")).distinct().collect()]   # one row per day of the batch
            if not fired:
                return
            there = sink.read_alerts(spark, store_root)
            there = there.where(F.col("day").isin(fired) if "day" in there.columns else F.to_date("fired_at").isin(fired))
            missing = new.join(there.select("alert_id"), "alert_id", "left_anti").select(*new.columns).persist()
            if not missing.isEmpty():
                sink.write_alerts(missing, store_root)
            missing.unpersist()
        finally:
            new.unpersist()

    w = readings_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)
    return w.start()
