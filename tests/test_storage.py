"""Reports over the stored, day-partitioned layout equal the in-memory
results, and time windows prune day partitions."""

import os

import pytest

from roomsense.operators import alerts as al
from roomsense.operators import dashboard as da
from roomsense.operators import environment as en
from roomsense.operators import occupancy as oc
from roomsense.sources import sink
from roomsense.tables import Tables
from tests.conftest import AS_OF


@pytest.fixture(scope="module")
def stored(spark, gold, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    sink.write_batch(gold.env, root, "env_readings", 0)
    sink.write_batch(gold.occ, root, "occupancy_readings", 0)
    sink.write_batch(gold.sectors, root, "sectors", 0)
    sink.write_batch(gold.sensors, root, "sensors", 0)
    gold.thresholds.write.parquet(f"{root}/thresholds")
    gold.alerts.write.parquet(f"{root}/alerts")
    t = Tables(sectors=sink.current_dimension(sink.read_table(spark, root, "sectors"), "sectors"),
               sensors=sink.current_dimension(sink.read_table(spark, root, "sensors"), "sensors"),
               env=sink.read_table(spark, root, "env_readings"),
               occ=sink.read_table(spark, root, "occupancy_readings"),
               thresholds=spark.read.parquet(f"{root}/thresholds"), alerts=spark.read.parquet(f"{root}/alerts"))
    return root, t


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_reports_equal_in_memory(stored, gold):
    _, t = stored
    _same(en.env_hourly(t, "30d", as_of=AS_OF), en.env_hourly(gold, "30d", as_of=AS_OF))
    _same(en.env_summary(t, as_of=AS_OF), en.env_summary(gold, as_of=AS_OF))
    _same(en.env_score(t), en.env_score(gold))
    _same(da.sector_heatmap(t, as_of=AS_OF).drop("co2_history"),
          da.sector_heatmap(gold, as_of=AS_OF).drop("co2_history"))
    _same(oc.occupancy_events(t), oc.occupancy_events(gold))
    _same(al.alert_kpis(t, as_of=AS_OF), al.alert_kpis(gold, as_of=AS_OF))


def test_window_prunes_days(stored):
    _, t = stored
    plan = en.env_hourly(t, "24h", as_of=AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "day#" in plan


def test_write_report(spark, stored, tmp_path):
    _, t = stored
    out = str(tmp_path / "report")
    sink.write_report(en.env_summary(t, as_of=AS_OF), out)
    assert spark.read.json(out).first().co2_avg == 900.0


def test_codes_upper_cased_at_load(spark, gold, tmp_path):
    root = str(tmp_path / "codes")
    sink.seed_store(root, gold.sectors, gold.sensors)
    from pyspark.sql import functions as F
    gold.alerts.withColumn("status", F.lower("status")).withColumn("severity", F.concat(F.lit(" "), "severity")) \
        .write.parquet(f"{root}/alerts")
    gold.thresholds.withColumn("parameter", F.lower("parameter")).write.parquet(f"{root}/thresholds")
    t = Tables.from_storage(spark, root)
    assert {r.status for r in t.alerts.collect()} == {"RESOLVIDO", "EM_ATENDIMENTO", "ABERTO"}
    assert [r.sector_name for r in al.open_critical_sectors(t).collect()] == ["Sala de Espera - Triagem"]
    assert {r.parameter for r in t.thresholds.collect()} >= {"CO2", "VOC"}


def test_feeds_register_dimensions_side_by_side(spark, gold, tmp_path):
    import datetime as dt
    from roomsense import schemas
    root = str(tmp_path / "dims")
    sink.seed_store(root, gold.sectors, gold.sensors)
    when = dt.datetime(2026, 1, 15)
    env_new = spark.createDataFrame([(77, "SENSOR_77", "DESCONHECIDO", 1, when, 1)], schemas.SENSORS)
    occ_new = spark.createDataFrame([(77, "SENSOR_77", "DESCONHECIDO", 1, when, 1),
                                     (88, "SENSOR_88", "DESCONHECIDO", 1, when, 1)], schemas.SENSORS)
    # both feeds' batch 0, written concurrently: neither overwrites the other
    sink.write_batch(env_new, root, "sensors", 0, source="env")
    sink.write_batch(occ_new, root, "sensors", 0, source="occ")
    raw = sink.read_table(spark, root, "sensors")
    assert raw.count() == 6 + 3
    cur = sink.current_dimension(raw, "sensors")
    assert sorted(r.sensor_id for r in cur.collect()) == [1, 2, 3, 6, 7, 8, 77, 88]
    # a seed row always wins over a later registration of the same id
    sink.write_batch(spark.createDataFrame([(3, "X", "DESCONHECIDO", 1, when, 1)], schemas.SENSORS),
                     root, "sensors", 5, source="occ")
    cur = sink.current_dimension(sink.read_table(spark, root, "sensors"), "sensors")
    assert cur.where("sensor_id = 3").first().sensor_code == "HPD2-UTI-A"


def test_readers_skip_uncommitted_folders(spark, gold, tmp_path):
    root = str(tmp_path / "snap")
    sink.write_snapshot(gold.env, root, "env_readings", 3)
    # a newer batch still being written: folder exists, only _temporary inside
    os.makedirs(os.path.join(sink.snapshot_path(root, "env_readings"), "batch_id=4", "_temporary", "0"))
    assert sink.newest_complete(spark, sink.snapshot_path(root, "env_readings")) == 3
    assert sink.read_snapshot(spark, root, "env_readings").count() == 6
    assert sink.read_snapshot(spark, root, "env_readings", before=3) is None


def test_a_window_lists_the_folders_of_its_days(spark, gold, tmp_path):
    import datetime as dt
    from pyspark.sql import functions as F
    from roomsense.tables import window_start
    root = str(tmp_path / "days")
    sink.seed_store(root, gold.sectors, gold.sensors)
    last = gold.env.select(F.max("ts")).first()[0].date()
    for n in range(6):   # batch n lies 5 - n times 3 days before the newest readings, the last is the golden one
        for facts, table in ((gold.env, "env_readings"), (gold.occ, "occupancy_readings")):
            sink.write_batch(facts.withColumn("id", F.col("id") + 1000 * n).withColumn("ts", F.col("ts") - F.make_dt_interval(F.lit(3 * (5 - n)))),
                             root, table, n)
    gold.thresholds.write.parquet(f"{root}/thresholds")
    since = window_start(spark, root, 1, as_of=AS_OF)
    assert since == last - dt.timedelta(days=1)
    whole, day = Tables.from_storage(spark, root), Tables.from_storage(spark, root, since)
    folders = {os.path.dirname(f).split("/env_readings/")[1] for f in day.env.inputFiles()}
    assert folders == {f"batch_id=5/day={d}" for d in {r[0] for r in gold.env.select(F.to_date("ts")).collect()} if d >= since}
    # neither do more batches of days long gone add a folder, nor does a report change
    before = len(sink.day_folders(spark, root, "env_readings", since))
    sink.write_batch(gold.env.withColumn("id", F.col("id") + 9000).withColumn("ts", F.col("ts") - F.make_dt_interval(F.lit(400))), root, "env_readings", 6)
    assert len(sink.day_folders(spark, root, "env_readings", since)) == before
    _same(en.env_hourly(day, "24h", as_of=AS_OF), en.env_hourly(whole, "24h", as_of=AS_OF))
    # a batch without known keys is read whole, its older days fall to the filter
    gold.env.withColumn("id", F.col("id") + 50_000).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{root}/env_readings/batch_id=7")
    again = sink.read_table(spark, root, "env_readings", since)
    assert again.where("id >= 50000").count() == gold.env.where(F.to_date("ts") >= F.lit(since)).count()
    assert sink.read_table(spark, root, "env_readings", dt.date(2100, 1, 1)).count() == 0
    assert window_start(spark, str(tmp_path / "none"), 1, as_of=AS_OF) is None
