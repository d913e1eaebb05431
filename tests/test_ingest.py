"""Ingest fixture (FIXTURES.md §4): landed occupancy files through the
streaming ingest job, plus the batch rules it is made of."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from roomsense.operators import ingest as ops
from roomsense.sources import landing, seed, sink
from roomsense.streaming.ingest import IngestJob, stored_ids


def _rec(i, data, sensor, people):
    return {"id": i, "data": data, "id_sensor": sensor, "delta": 60, "pessoas": people,
            "luminosidade": 300.0, "umidade": 50.0, "temperatura": 22.0}


D = "2026-01-15 "
FILE_A = [_rec(1, D + "00:00:05", 3, 4), _rec(2, D + "00:00:05", 3, 9), _rec(1, D + "00:02:05", 3, 5),
          _rec(3, D + "00:01:05", 3, None), _rec(4, D + "00:03:05", 99, 6), _rec(5, "not-a-date", 3, 6),
          _rec(8, D + "00:05:05", 3, 300)]
FILE_B = [_rec(2, D + "00:06:05", 3, 7), _rec(4, D + "00:03:05", 99, 6), _rec(6, "2020-01-01 00:00:00", 3, 2)]


def _land(folder, name, rows, mtime):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")
    os.utime(path, (mtime, mtime))
    return path


@pytest.fixture()
def store(spark, tmp_path):
    root = str(tmp_path / "store")
    sink.seed_store(root, seed.sectors(spark), seed.sensors(spark))
    return root


def test_stream_ingest_fixture(spark, store, tmp_path):
    land = str(tmp_path / "landing")
    _land(land, "a.json", FILE_A, 1_000_000)
    job = IngestJob(spark, store, "occ")
    q = job.start(land, checkpoint=str(tmp_path / "ck"), available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    assert stored_ids(spark, store, "occ") == [1, 4, 8]
    _land(land, "b.json", FILE_B, 2_000_000)
    q = job.start(land, checkpoint=str(tmp_path / "ck"), available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    assert stored_ids(spark, store, "occ") == [1, 2, 4, 6, 8]
    first = sink.read_table(spark, store, "occupancy_readings").where("id = 1").first()
    assert first.people == 4 and first.ts == dt.datetime(2026, 1, 15, 0, 0, 5)
    quarantine = spark.read.parquet(f"{store}/quarantine_occ")
    assert sorted(r.id for r in quarantine.collect()) == [3, 5]
    metrics = sorted((r.batch_id, r.received, r.inserted) for r in spark.read.json(f"{store}/_metrics_occ").collect())
    assert [(m[1], m[2]) for m in metrics] == [(7, 3), (3, 2)]
    s99 = sink.read_table(spark, store, "sensors").where("sensor_id = 99").collect()
    assert [(r.sensor_code, r.sensor_type, r.sector_id) for r in s99] == [("SENSOR_99", "DESCONHECIDO", 1)]
    # sector 1 exists already: nothing registered
    assert sink.read_table(spark, store, "sectors").count() == 5


def test_replay_is_idempotent(spark, store, tmp_path):
    land = str(tmp_path / "landing")
    pa = _land(land, "a.json", FILE_A, 1_000_000)
    pb = _land(land, "b.json", FILE_B, 2_000_000)
    job = IngestJob(spark, store, "occ")

    def raw(path):
        return job.with_arrival(spark.read.schema(landing.feed_schema("occ")).json(path))

    job.process(raw(pa), 0)
    job.process(raw(pb), 1)
    before = stored_ids(spark, store, "occ")
    job.process(raw(pb), 1)
    assert stored_ids(spark, store, "occ") == before == [1, 2, 4, 6, 8]


def test_mark_read_returns_nothing_for_file_b(spark, tmp_path):
    pb = _land(str(tmp_path / "l"), "b.json", FILE_B, 2_000_000)
    assert landing.incremental(landing.read_feed(spark, pb, "occ"), 8).count() == 0
    assert landing.incremental(landing.read_feed(spark, pb, "occ"), None).count() == 0


def test_eight_bit_rule(spark, tmp_path):
    pa = _land(str(tmp_path / "l"), "a.json", FILE_A, 1_000_000)
    parsed = ops.parse_feed(landing.read_feed(spark, pa, "occ"), "occ")
    good, bad = ops.split_valid(parsed, "occ", eight_bit=True)
    assert sorted(r.id for r in bad.collect()) == [3, 5, 8]
    good, bad = ops.split_valid(parsed, "occ", eight_bit=False)
    assert sorted(r.id for r in bad.collect()) == [3, 5]


def test_c7_chained_conflict(spark):
    t1, t2 = dt.datetime(2026, 1, 1, 0, 0, 0), dt.datetime(2026, 1, 1, 0, 1, 0)
    batch = spark.createDataFrame([(1, t1, 3, 1), (2, t1, 3, 2), (2, t2, 3, 3)],
                                  "id long, ts timestamp_ntz, sensor_id long, _arrival long")
    got = [(r.id, r.ts) for r in ops.first_per_key(batch).collect()]
    # row-by-row insertion would keep (1, t1) and (2, t2); our rule keeps only (1, t1)
    assert got == [(1, t1)]


def test_initial_window(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2026, 1, 14, 23, 0)), (2, dt.datetime(2026, 1, 16, 1, 0)),
                                  (3, dt.datetime(2026, 1, 13, 23, 0))], "id long, ts timestamp_ntz")
    got = sorted(r.id for r in landing.initial_window(rows, 1, as_of="2026-01-15 10:00:00").collect())
    # dates 15/01..16/01 inclusive
    assert got == [2]


def test_high_water_mark(spark):
    df = spark.createDataFrame([(5,), (9,)], "id long")
    assert spark.range(1).select(landing.high_water_mark(df).alias("m")).first().m == 9
    empty = df.where(F.lit(False))
    assert spark.range(1).select(landing.high_water_mark(empty).alias("m")).first().m is None


def _env(i, data, sensor, co2):
    return {"id": i, "data": data, "id_sensor": sensor, "delta": 60, "luminosidade": 300.0, "umidade": 50.0,
            "temperatura": 22.0, "voc": 100.0, "co2": co2, "pressao_ar": 1013.0, "ruido": 40.0,
            "aerosol_parado": 0, "aerosol_risco": 0, "ponto_orvalho": 10.0}


def test_env_feed_with_initial_window(spark, store, tmp_path):
    land = str(tmp_path / "landing_env")
    _land(land, "a.json", [_env(10, "2026-01-15 08:00:00", 1, 700.0), _env(11, "2026-01-10 08:00:00", 1, 650.0),
                           _env(12, "2026-01-15 09:00:00", 1, None)], 1_000_000)
    job = IngestJob(spark, store, "env", initial_days=1, as_of="2026-01-15 10:00:00")
    q = job.start(land, checkpoint=str(tmp_path / "ck_env"), available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    # id 11 is outside the first pass's date window; id 12 lacks co2 (quarantine)
    assert stored_ids(spark, store, "env") == [10]
    assert sorted(r.id for r in spark.read.parquet(f"{store}/quarantine_env").collect()) == [12]
    _land(land, "b.json", [_env(11, "2026-01-10 08:00:00", 1, 650.0)], 2_000_000)
    q = job.start(land, checkpoint=str(tmp_path / "ck_env"), available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    # later passes take whatever lands, old event times included
    assert stored_ids(spark, store, "env") == [10, 11]


def test_ingest_maintains_recent_snapshot(spark, store, tmp_path):
    land = str(tmp_path / "landing")
    rows = [_rec(100 + i, f"2026-01-15 10:{i:02d}:00", 3, i % 7) for i in range(30)]
    _land(land, "a.json", rows[:25], 1_000_000)
    job = IngestJob(spark, store, "occ", keep_seconds=0)
    ck = str(tmp_path / "ck")
    job.start(land, checkpoint=ck, available_now=True, max_files_per_trigger=1).awaitTermination()
    _land(land, "b.json", rows[25:], 2_000_000)
    job.start(land, checkpoint=ck, available_now=True, max_files_per_trigger=1).awaitTermination()
    snap = sink.read_snapshot(spark, store, "occupancy_readings")
    assert sorted(r.id for r in snap.collect()) == list(range(110, 130))
    # an older snapshot is kept for readers in flight; none older than that
    import os as _os
    kept = sorted(_os.listdir(sink.snapshot_path(store, "occupancy_readings")))
    assert [k for k in kept if k.startswith("batch_id=")] == ["batch_id=0", "batch_id=1"]


def test_empty_batch_is_a_noop(spark, store, tmp_path):
    land = str(tmp_path / "landing")
    _land(land, "a.json", FILE_A, 1_000_000)
    job = IngestJob(spark, store, "occ")
    ck = str(tmp_path / "ck")
    job.start(land, checkpoint=ck, available_now=True, max_files_per_trigger=1).awaitTermination()
    _land(land, "empty.json", [], 2_000_000)   # I05: a failed fetch lands nothing
    job.start(land, checkpoint=ck, available_now=True, max_files_per_trigger=1).awaitTermination()
    assert stored_ids(spark, store, "occ") == [1, 4, 8]
    snap = sink.read_snapshot(spark, store, "occupancy_readings")
    assert sorted(r.id for r in snap.collect()) == [1, 4, 8]


def test_missing_sector_is_registered(spark):
    telemetry = spark.createDataFrame([(2,), (3,), (42,)], "sensor_id long")
    sensors = seed.sensors(spark).where("sensor_id <> 2")          # device 2 unknown
    sectors = seed.sectors(spark).where("sector_id <> 3")          # and its mapped sector 3 missing
    new = ops.new_sensors(telemetry, sensors)
    got = sorted((r.sensor_id, r.sensor_code, r.sensor_type, r.sector_id) for r in new.collect())
    assert got == [(2, "SENSOR_2", "HPD2", 3), (42, "SENSOR_42", "DESCONHECIDO", 1)]
    sec = [(r.sector_id, r.sector_name, r.sector_type, r.max_capacity, r.active)
           for r in ops.new_sectors(new, sectors).collect()]
    assert sec == [(3, "Setor 3", "Geral", 25, 1)]


def test_polling_form_with_mark(spark, store, tmp_path):
    land = str(tmp_path / "l")
    pa = _land(land, "a.json", [_rec(1, "2026-01-15 00:00:05", 3, 4), _rec(2, "2026-01-10 00:00:05", 3, 4),
                                _rec(8, "2026-01-15 00:05:05", 3, 5)], 1_000_000)
    job = IngestJob(spark, store, "occ", as_of="2026-01-15 10:00:00")
    # first pass: date window 15/01..16/01 (id 2 is older)
    assert job.poll_once(pa, 0, first_pass=True)["inserted"] == 2
    assert stored_ids(spark, store, "occ") == [1, 8]
    assert job.read_mark() == 8
    pb = _land(land, "b.json", FILE_B, 2_000_000)
    # later pass: mark 8, so file b's ids 2, 4, 6 are not read again
    assert job.poll_once(pb, 1)["inserted"] == 0
    assert job.read_mark() == 8
    pc = _land(land, "c.json", [_rec(9, "2026-01-15 00:09:05", 3, 1)], 3_000_000)
    assert job.poll_once(pc, 2)["inserted"] == 1
    assert stored_ids(spark, store, "occ") == [1, 8, 9]
    assert job.read_mark() == 9
    # replaying pass 2 starts again from mark 8 and rewrites the same mark
    job.poll_once(pc, 2)
    assert job.read_mark() == 9 and stored_ids(spark, store, "occ") == [1, 8, 9]


def test_polling_skips_refresh_on_empty_table(spark, store, tmp_path):
    pb = _land(str(tmp_path / "l"), "b.json", FILE_B, 2_000_000)
    out = IngestJob(spark, store, "env").poll_once(pb, 0)
    assert out.get("skipped") is True


def _wide(ids, day, sensor=3):
    return [_rec(i, f"2026-01-{day:02d} {i % 24:02d}:{i // 24 % 60:02d}:00", sensor, 1) for i in ids]


def test_a_late_row_opens_its_day_and_its_batch_only(spark, store, tmp_path):
    land = str(tmp_path / "landing")
    job = IngestJob(spark, store, "occ")
    for n in range(5):   # five batches, each with its own days and id pages
        path = _land(land, f"{n}.json", _wide([n * sink.PAGE_IDS + i for i in range(3)], 2 + 3 * n), 1_000_000 + n)
        job.process(job.with_file(landing.read_feed(spark, path, "occ")), n)
    late = spark.createDataFrame([(sink.PAGE_IDS + 1, dt.datetime(2026, 1, 5, 1), 3)], "id long, ts timestamp_ntz, sensor_id long")
    batch = late.unionByName(spark.createDataFrame([(4 * sink.PAGE_IDS + 9, dt.datetime(2026, 1, 14, 9), 3)], late.schema))
    span = ops.key_span(batch)
    assert span.days == [dt.date(2026, 1, 5), dt.date(2026, 1, 14)] and span.pages == [1, 4]
    span.batches = sink.key_batches(spark, store, "occupancy_readings", span.pages)
    assert span.batches == [1, 4]
    stored = sink.read_table(spark, store, "occupancy_readings")
    left = ops.drop_stored(batch, stored, span=span)
    assert [r.id for r in left.collect()] == [4 * sink.PAGE_IDS + 9]
    plan = spark._jvm.PythonSQLUtils.explainString(left._jdf.queryExecution(), "formatted")
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("batch_id" in f and "1" in f and "4" in f for f in filters) and any("day" in f for f in filters)


def test_keys_of_many_batches_share_files_and_unknown_batches_count(spark, store, monkeypatch):
    monkeypatch.setattr(sink, "KEY_BLOCK", 4)
    row = spark.createDataFrame([_rec(0, D + "00:00:05", 3, 4)], "id long, data string, id_sensor long, delta int, pessoas int, luminosidade double, umidade double, temperatura double")
    facts = ops.parse_feed(row, "occ")
    for n in range(6):
        sink.write_batch(facts.withColumn("id", F.lit(n * sink.PAGE_IDS)), store, "occupancy_readings", n)
    opened = {n // 4: n for n in sink.batch_numbers(spark, f"{store}/_keys_occupancy_readings")}
    assert spark.read.schema(sink.KEYS).parquet(*(f"{store}/_keys_occupancy_readings/batch_id={n}" for n in opened.values())).count() == 6
    assert sink.key_batches(spark, store, "occupancy_readings", [2, 5, 77]) == [2, 5]
    assert sink.key_batches(spark, store, "occupancy_readings", [2, 5], but=5) == [2]
    facts.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{store}/occupancy_readings/batch_id=9")   # not by the sink
    assert sink.key_batches(spark, store, "occupancy_readings", [2]) == [2, 9]
    sink.write_batch(facts, store, "occupancy_readings", 3)   # a replay with other keys
    assert sink.key_batches(spark, store, "occupancy_readings", [0, 3]) == [0, 3, 9]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_feed_times_know_no_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-02-29 23:59:59", "2023-02-29 00:00:00", "2024-01-01 24:00:00", "2024-01-01T10:00:00",
             "2024-01-01 10:00", " 2024-01-01 10:00:00", "2024-01-01 10:00:00Z", "", None]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ops.wall_clock("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(2024, 2, 29, 23, 59, 59)] + [None] * 8


def test_a_device_whose_rows_are_all_quarantined_is_registered_once(spark, store, tmp_path):
    land = str(tmp_path / "landing")
    path = _land(land, "a.json", [_rec(1, "no date", 77, 4), _rec(2, D + "00:00:05", 77, None), _rec(3, D + "00:00:05", 3, 4)], 1_000_000)
    job = IngestJob(spark, store, "occ")
    for _ in range(2):   # the second time as a replay
        job.process(job.with_file(landing.read_feed(spark, path, "occ")), 0)
    rows = sink.read_table(spark, store, "sensors").where("sensor_id = 77").collect()
    assert [(r.sensor_code, r.sector_id) for r in rows] == [("SENSOR_77", 1)]
    assert stored_ids(spark, store, "occ") == [3]
    broken = spark.read.json(f"{store}/_metrics_occ").first()["broken"]
    assert sorted((b["constraint"], b["rows"]) for b in broken) == [("not_null(people)", 1), ("not_null(ts)", 1)]


def test_the_anchor_of_a_store_is_one_small_file(spark, store):
    from roomsense.tables import Tables
    env = seed.thresholds(spark).limit(1).selectExpr("1L id", "timestamp_ntz'2026-01-15 11:30:00' ts", "1L sensor_id", "60 delta_s", *(
        f"1.0D {c}" for c in ("luminosity", "humidity", "temperature", "voc", "co2", "pressure", "noise")), "0 aerosol_still", "0 aerosol_risk", "1.0D dew_point")
    sink.write_batch(env, store, "env_readings", 0)
    sink.write_batch(env.withColumn("ts", F.expr("ts - interval 3 days")).withColumn("id", F.lit(2)), store, "env_readings", 1)   # older rows come later
    t = Tables.from_storage(spark, store)
    assert spark.range(1).select(t.anchor()).first()[0] == dt.datetime(2026, 1, 15, 11, 30)
    assert len(t.env_latest.inputFiles()) == 1 and "_latest_env_readings/batch_id=1" in t.env_latest.inputFiles()[0]
    sink.write_batch(env.withColumn("ts", F.expr("ts + interval 1 day")), store, "env_readings", 0)   # a replay
    assert sink.read_latest(spark, store, "env_readings").count() == 1
    assert t.replace(env=env.limit(0)).env_latest is None
