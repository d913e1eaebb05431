"""The command line: report -> JSON over a store, ingest --once."""

import json
import os

from roomsense.__main__ import REPORTS, main
from roomsense.sources import sink


def _store(gold, root):
    sink.seed_store(root, gold.sectors, gold.sensors)
    sink.write_batch(gold.env, root, "env_readings", 0)
    sink.write_batch(gold.occ, root, "occupancy_readings", 0)
    gold.thresholds.write.parquet(f"{root}/thresholds")
    gold.alerts.write.parquet(f"{root}/alerts")


def test_report_writes_json(spark, gold, tmp_path):
    root = str(tmp_path / "store")
    _store(gold, root)
    out = str(tmp_path / "heatmap")
    assert main(["report", "sector_heatmap", "--store", root, "--out", out, "--as-of", "2026-01-15 12:00:00"]) == 0
    tiles = {r["sector_id"]: r for r in (json.loads(line) for f in os.listdir(out) if f.endswith(".json")
                                         for line in open(os.path.join(out, f)))}
    assert tiles[1]["people"] == 11 and tiles[1]["co2_history"] == [1100.0, 800.0, 1000.0]
    out2 = str(tmp_path / "events")
    assert main(["report", "occupancy_events", "--sector-id", "2", "--store", root, "--out", out2]) == 0
    assert spark.read.json(out2).first().event == "Sem movimentação detectada"


def test_every_report_name_runs(spark, gold, tmp_path):
    root = str(tmp_path / "store")
    _store(gold, root)
    for name in REPORTS:
        out = str(tmp_path / f"r_{name}")
        assert main(["report", name, "--store", root, "--out", out, "--as-of", "2026-01-15 12:00:00",
                     "--around", "2026-01-15 05:20:00"]) == 0, name


def test_minutes_of_a_time_range(spark, gold, tmp_path):
    from roomsense.operators import occupancy as oc
    root, out = str(tmp_path / "store"), str(tmp_path / "minutes")
    _store(gold, root)
    whole = oc.co2_people_by_minute(gold).collect()
    minute = str(min(r["minute"] for r in whole))[:16]
    assert main(["report", "co2_people_by_minute", "--store", root, "--out", out, "--start", f"{minute}:00", "--end", f"{minute}:59"]) == 0
    assert spark.read.json(out).count() == sum(str(r["minute"])[:16] == minute for r in whole) > 0


def test_ingest_once(spark, gold, tmp_path):
    root = str(tmp_path / "store")
    sink.seed_store(root, gold.sectors, gold.sensors)
    land = tmp_path / "landing"
    land.mkdir()
    (land / "a.json").write_text(json.dumps({"id": 1, "data": "2026-01-15 00:00:05", "id_sensor": 3, "delta": 60,
                                             "pessoas": 4, "luminosidade": 1.0, "umidade": 1.0,
                                             "temperatura": 1.0}) + "\n")
    assert main(["ingest", "--kind", "occ", "--store", root, "--landing", str(land),
                 "--checkpoint", str(tmp_path / "ck"), "--once"]) == 0
    assert sink.read_table(spark, root, "occupancy_readings").count() == 1
