"""The auto-refreshing hourly tiles as a streaming aggregate.

Readings stream in; hourly means are kept in state and emitted in ``update``
mode; each trigger's updated buckets are appended to a changelog folder and
the report reads the newest version of each bucket.  Event time must be a
TIMESTAMP for the watermark (C2); it is derived from the NTZ time without the
session zone, and the bucket is taken from the NTZ fields.

The state is one row per hour bucket (not per sensor), so the watermark can
cover the widest report window (30 days + the anchor hour): about 744 state
rows, and any reading that any report window could still include is
counted — the stream then equals batch Q05 on the same rows.

A replayed ingest batch rewrites its files, which the file source takes as
new.  Below the aggregate a keyed state drops every reading whose id it has
seen, so a reading counts once however often its batch is replayed.  That
state holds the ids inside the watermark, spread over the state partitions by
id; it is evicted as the watermark passes, like the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomsense.functions import ddmm_hhmm, hour_bucket
from roomsense.plans.windows import anchor, hours, period_hours, since
from roomsense.sources.sink import KEEP_SECONDS, newest_complete, prune_folders

ENV_VARS = ("co2", "voc", "temperature", "humidity")


def once_per_reading(readings: DataFrame, watermark: str = "31 days") -> DataFrame:
    """Each reading id once, with its event time ``_ets``; on a stream within the watermark."""
    # event time = the wall clock read as UTC (unix_timestamp of an NTZ value
    # ignores the session zone), so the epoch-aligned hour windows coincide
    # with the wall-clock hour buckets in every session time zone
    ev = readings.select("id", "ts", *ENV_VARS, F.timestamp_seconds(F.unix_timestamp("ts")).alias("_ets"))
    if readings.isStreaming:
        return ev.withWatermark("_ets", watermark).dropDuplicatesWithinWatermark(["id"])
    return ev.dropDuplicates(["id"])


def hourly_state(readings: DataFrame, watermark: str = "31 days") -> DataFrame:
    """Streaming (or batch) hourly sums and counts per bucket, each reading counted once."""
    g = once_per_reading(readings, watermark).groupBy(F.window("_ets", "1 hour").alias("w"), hour_bucket("ts").alias("bucket")).agg(
        F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"),
        *[F.sum(v).alias(f"sum_{v}") for v in ENV_VARS])
    return g.select("bucket", "first_ts", "n", *[f"sum_{v}" for v in ENV_VARS])


def _merge_state(prev: DataFrame | None, updates: DataFrame, horizon_hours: int) -> DataFrame:
    """Current buckets = previous state overridden by this trigger's updated
    buckets (an update carries the bucket's full running aggregate), kept
    within ``horizon_hours`` of the newest bucket."""
    cols = updates.columns
    if prev is None:
        merged = updates
    else:
        fresh = updates.select("bucket").withColumn("_new", F.lit(True))
        old = prev.select(*cols).join(fresh, "bucket", "left_anti")
        merged = old.unionByName(updates)
    newest = merged.select(F.max("bucket")).scalar()
    return merged.where(F.col("bucket") >= newest - hours(horizon_hours))


def start_hourly(readings_stream: DataFrame, out_dir: str, checkpoint: str, available_now: bool = False,
                 period: str = "30 seconds", horizon_hours: int = 31 * 24, keep: int = 3, keep_seconds: int = KEEP_SECONDS):
    """Each trigger writes the whole current state (at most ~744 hour rows)
    as ``out_dir/batch_id=N`` and prunes older folders (those above ``keep_seconds`` of age), so the folder count
    stays constant however long the stream runs; a replayed trigger merges
    with state N-1 again and rewrites the same folder."""
    spark = readings_stream.sparkSession

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()   # used several times below; the state store must advance once per trigger
        try:
            state = _merge_state(_read_state(spark, out_dir, before=batch_id), df, horizon_hours)
            state.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        finally:
            df.unpersist()
        prune_folders(spark, out_dir, keep_from=batch_id - keep + 1, keep_seconds=keep_seconds)

    w = (hourly_state(readings_stream).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)
    return w.start()


def _read_state(spark: SparkSession, out_dir: str, before: int | None = None) -> DataFrame | None:
    """The newest committed state folder (never one still being written)."""
    newest = newest_complete(spark, out_dir, before)
    if newest is None:
        return None
    return spark.read.parquet(f"{out_dir}/batch_id={newest}")


def read_hourly(spark: SparkSession, out_dir: str, env: DataFrame, period: str = "24h", *, as_of=None) -> DataFrame:
    """Q05 from the streamed state: the newest state folder, the same anchor
    window and rounding as the batch report.  The window begins inside an hour
    unless the anchor is on one, so that first hour is aggregated from its own
    readings; all later hours come from the state."""
    a = anchor(env, as_of)
    start = a - hours(period_hours(period))
    edge = hour_bucket(start)
    first = since(env, start).where(F.col("ts") < edge + hours(1))
    cur = _read_state(spark, out_dir).where(F.col("bucket") > edge).unionByName(hourly_state(first))
    return cur.select(
        "bucket", ddmm_hhmm("first_ts").alias("label"),
        *[F.round(F.col(f"sum_{v}") / F.col("n"), 1).alias(name)
          for v, name in zip(ENV_VARS, ("co2", "voc", "temp", "humid"))]).orderBy("bucket")
