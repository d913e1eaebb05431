"""The ingest job over stores with a past: slices, new checkpoints, filled stores, empty passes; Q12 for orphan sectors."""

import os

import pytest
from pyspark.sql import functions as F

from roomsense.operators import occupancy as oc
from roomsense.sources import seed, sink
from roomsense.streaming.ingest import IngestJob, stored_ids
from roomsense.tables import Tables
from tests.conftest import golden
from tests.test_ingest import _land, _rec

D = "2026-01-15 "


@pytest.fixture()
def store(spark, tmp_path):
    root = str(tmp_path / "store")
    sink.seed_store(root, seed.sectors(spark), seed.sensors(spark))
    return root


def _run(job, land, ck, files):
    q = job.start(land, checkpoint=ck, available_now=True, max_files_per_trigger=files)
    q.awaitTermination()


@pytest.mark.parametrize("files", [1, 10_000])
def test_initial_window_does_not_depend_on_slices(spark, store, tmp_path, files):
    land = str(tmp_path / "landing")
    _land(land, "a.json", [_rec(1, D + "08:00:00", 3, 4)], 1_000_000)
    _land(land, "b.json", [_rec(2, "2026-01-02 08:00:00", 3, 5)], 1_000_100)
    job = IngestJob(spark, store, "occ", initial_days=1, as_of="2026-01-15 10:00:00")
    _run(job, land, str(tmp_path / "ck"), files)
    assert stored_ids(spark, store, "occ") == [1]
    _land(land, "c.json", [_rec(3, "2026-01-02 09:00:00", 3, 5)], 1_000_200)
    _run(job, land, str(tmp_path / "ck"), files)
    assert stored_ids(spark, store, "occ") == [1, 3]


def test_new_checkpoint_keeps_what_is_stored(spark, store, tmp_path):
    for n, ck in ((1, "ck1"), (9, "ck2")):
        land = str(tmp_path / f"landing{n}")
        _land(land, "a.json", [_rec(n, f"{D}0{n}:00:00", 3, n)], 1_000_000)
        _run(IngestJob(spark, store, "occ"), land, str(tmp_path / ck), 10)
    assert stored_ids(spark, store, "occ") == [1, 9]
    newest = Tables.from_storage(spark, store).recent_occ
    assert sorted(r["id"] for r in newest.select("id").collect()) == [1, 9]


def test_first_snapshot_covers_a_filled_store(spark, store, tmp_path):
    sink.write_batch(golden(spark).occ, store, "occupancy_readings", 0)
    land = str(tmp_path / "landing")
    _land(land, "a.json", [_rec(500, D + "11:30:00", 6, 3)], 1_000_000)
    _run(IngestJob(spark, store, "occ"), land, str(tmp_path / "ck"), 10)
    t = Tables.from_storage(spark, store)
    history = t.replace(recent_occ=None, recent_env=None)
    for report in (oc.occupancy_now, oc.occupancy_history, oc.occupancy_events):
        assert sorted(map(str, report(t).collect())) == sorted(map(str, report(history).collect()))
    assert t.recent_occ.where("sensor_id = 3").count() > 0


def test_empty_pass_writes_nothing(spark, store, tmp_path):
    def files():
        return sum(len(f) for _, _, f in os.walk(store))

    land = str(tmp_path / "landing")
    _land(land, "a.json", [_rec(1, D + "08:00:00", 3, 4)], 1_000_000)
    job = IngestJob(spark, store, "occ")
    job.poll_once(land, 0, first_pass=True, dias=10_000)
    before = files()
    for n in range(1, 4):
        assert job.poll_once(land, n) == {"batch_id": n, "received": 0, "inserted": 0, "skipped": True}
    assert files() == before


def test_orphan_sector_counts_with_the_default_capacity_either_way(spark):
    t = golden(spark)
    t = t.replace(sensors=t.sensors.withColumn("sector_id", F.when(F.col("sensor_id") == 3, F.lit(77)).otherwise(F.col("sector_id")).cast("long")))
    one = sorted(map(str, oc.occupancy_events(t, sector_id=77).collect()))
    every = sorted(map(str, oc.occupancy_events(t).where("sector_id = 77").collect()))
    assert one == every and "/25" in one[0]
