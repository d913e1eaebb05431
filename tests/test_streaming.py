"""Batch-vs-stream equality for I11 (hourly tiles) and I12 (alert raising)."""

import os

from pyspark.sql import functions as F

from roomsense import schemas
from roomsense.operators import alerts as al
from roomsense.operators import environment as en
from roomsense.operators import thresholds as th
from roomsense.sources import sink
from roomsense.streaming import alerting, hourly
from roomsense.tables import Tables
from tests.conftest import AS_OF


def _land_env(gold, folder):
    # one file per reading: the stream sees them over several triggers
    gold.env.repartition(6, "id").write.mode("overwrite").parquet(folder)


def test_hourly_stream_equals_batch(spark, gold, tmp_path):
    land = str(tmp_path / "env")
    _land_env(gold, land)
    stream = spark.readStream.schema(schemas.ENV_READINGS).option("maxFilesPerTrigger", 1).parquet(land)
    out = str(tmp_path / "hourly")
    q = hourly.start_hourly(stream, out, str(tmp_path / "ck"), available_now=True, keep_seconds=0)
    q.awaitTermination()
    folders = [f for f in os.listdir(out) if f.startswith("batch_id=")]
    assert 1 <= len(folders) <= 3   # state folders are pruned, not accumulated
    for period in ("24h", "30d"):
        got = [tuple(r) for r in hourly.read_hourly(spark, out, gold.env, period, as_of=AS_OF).collect()]
        want = [tuple(r) for r in en.env_hourly(gold, period, as_of=AS_OF).collect()]
        assert got == want


def test_alert_stream_equals_batch(spark, gold, tmp_path):
    land = str(tmp_path / "env")
    _land_env(gold, land)
    stream = spark.readStream.schema(schemas.ENV_READINGS).parquet(land)
    out = str(tmp_path / "alerts")
    q = alerting.start_alerts(gold, stream, out, str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    cols = ["reading_id", "parameter", "severity", "limit_ref"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*cols).collect())
    want = sorted(tuple(r) for r in th.alerts_from_thresholds(gold).select(*cols).collect())
    assert got == want and len(got) > 0


def test_hourly_stream_equals_batch_when_the_window_begins_inside_an_hour(spark, gold, tmp_path):
    more = gold.env.withColumn("id", F.col("id") + 100).withColumn("ts", F.expr("timestampadd(MINUTE, -25, ts)")).withColumn("co2", F.col("co2") + 70)
    t = gold.replace(env=gold.env.unionByName(more))
    land, out = str(tmp_path / "env"), str(tmp_path / "hourly")
    _land_env(t, land)
    stream = spark.readStream.schema(schemas.ENV_READINGS).option("maxFilesPerTrigger", 2).parquet(land)
    hourly.start_hourly(stream, out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    for period in ("24h", "7d", "30d"):
        got = [tuple(r) for r in hourly.read_hourly(spark, out, t.env, period, as_of=AS_OF).collect()]
        assert got == [tuple(r) for r in en.env_hourly(t, period, as_of=AS_OF).collect()]


def test_store_alerts_reach_the_alerts_table_and_new_devices_raise(spark, gold, tmp_path):
    store, land, ck = str(tmp_path / "store"), str(tmp_path / "env"), str(tmp_path / "ck")
    first = gold.sensors.where("sensor_id = 1")
    sink.seed_store(store, gold.sectors, gold.sensors.where("sensor_id <> 1"))
    gold.thresholds.write.parquet(f"{store}/thresholds")
    schema = schemas.ENV_READINGS

    def run(checkpoint=ck):
        stream = spark.readStream.schema(schema).parquet(land)
        alerting.start_store_alerts(spark, store, stream, checkpoint, available_now=True).awaitTermination()
        return Tables.from_storage(spark, store).alerts

    gold.env.where("id <= 3").write.parquet(land)
    assert run().count() == 0   # the device is not registered yet
    sink.write_batch(first, store, "sensors", 0, source="env")
    gold.env.where("id > 3").write.mode("append").parquet(land)
    found = run()
    want = th.alerts_from_thresholds(gold, gold.env.where("id > 3"))
    cols = ["sensor_id", "parameter", "measured", "severity"]
    assert sorted(map(str, found.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert run(str(tmp_path / "again")).count() == th.alerts_from_thresholds(gold).count()   # a replay adds only what was missing
    t = Tables.from_storage(spark, store)
    assert al.alert_list(t, as_of=AS_OF).count() == min(50, t.alerts.count()) > 0
    assert al.alert_list(t, severity=" critico ", as_of=AS_OF).where("severity <> 'CRITICO'").count() == 0


def test_tiles_count_replayed_batches_once(spark, gold, tmp_path):
    """Stream = batch for every period with an anchor inside an hour, before and after a replay, also across restarts."""
    root, out, ck = str(tmp_path / "store"), str(tmp_path / "tiles"), str(tmp_path / "ck")
    more = gold.env.withColumn("id", F.col("id") + 100).withColumn("ts", F.expr("timestampadd(MINUTE, -25, ts)")).withColumn("co2", F.col("co2") + 70)

    def run():
        hourly.start_hourly(sink.stream_table(spark, root, "env_readings", 1), out, ck, available_now=True).awaitTermination()

    def check():
        stored = sink.read_table(spark, root, "env_readings")
        t = gold.replace(env=stored)
        assert t.env.agg(F.max("ts")).first()[0].minute != 0
        for period in ("24h", "7d", "30d"):
            got = [tuple(r) for r in hourly.read_hourly(spark, out, stored, period, as_of=AS_OF).collect()]
            assert got == [tuple(r) for r in en.env_hourly(t, period, as_of=AS_OF).collect()], period

    sink.write_batch(gold.env, root, "env_readings", 0)
    run()
    check()
    sink.write_batch(gold.env.repartition(3), root, "env_readings", 0)   # a replay: the same rows in new files
    sink.write_batch(more, root, "env_readings", 1)
    run()
    check()
    sink.write_batch(more, root, "env_readings", 1)
    run()
    check()
