"""End to end: golden telemetry landed as feed files -> streaming ingest ->
store -> Tables.from_storage -> reports equal the in-memory golden reports."""

import json
import os

import pytest

from roomsense.operators import alerts as al
from roomsense.operators import dashboard as da
from roomsense.operators import environment as en
from roomsense.operators import occupancy as oc
from roomsense.sources import sink
from roomsense.streaming.ingest import IngestJob
from roomsense.tables import Tables
from tests.conftest import AS_OF


def _feed_env(r):
    return {"id": r.id, "data": r.ts.strftime("%Y-%m-%d %H:%M:%S"), "id_sensor": r.sensor_id, "delta": r.delta_s,
            "luminosidade": r.luminosity, "umidade": r.humidity, "temperatura": r.temperature, "voc": r.voc,
            "co2": r.co2, "pressao_ar": r.pressure, "ruido": r.noise, "aerosol_parado": r.aerosol_still,
            "aerosol_risco": r.aerosol_risk, "ponto_orvalho": r.dew_point}


def _feed_occ(r):
    return {"id": r.id, "data": r.ts.strftime("%Y-%m-%d %H:%M:%S"), "id_sensor": r.sensor_id, "delta": r.delta_s,
            "pessoas": r.people, "luminosidade": r.luminosity, "umidade": r.humidity, "temperatura": r.temperature}


def _land(folder, rows, chunks):
    os.makedirs(folder, exist_ok=True)
    for i in range(chunks):
        path = os.path.join(folder, f"part-{i:03d}.json")
        with open(path, "w") as fh:
            for r in rows[i::chunks]:
                fh.write(json.dumps(r) + "\n")
        os.utime(path, (1_000_000 + i, 1_000_000 + i))


@pytest.fixture(scope="module")
def pipeline_root(spark, gold, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    root = str(base / "store")
    sink.seed_store(root, gold.sectors, gold.sensors)
    gold.thresholds.write.parquet(f"{root}/thresholds")
    gold.alerts.write.parquet(f"{root}/alerts")
    env_rows = sorted(gold.env.collect(), key=lambda r: r.ts)
    occ_rows = sorted(gold.occ.collect(), key=lambda r: r.ts)
    _land(str(base / "land_env"), [_feed_env(r) for r in env_rows], 3)
    _land(str(base / "land_occ"), [_feed_occ(r) for r in occ_rows], 4)
    for kind in ("env", "occ"):
        q = IngestJob(spark, root, kind).start(str(base / f"land_{kind}"), checkpoint=str(base / f"ck_{kind}"),
                                               available_now=True, max_files_per_trigger=1)
        q.awaitTermination()
    return root


@pytest.fixture(scope="module")
def stored(spark, pipeline_root):
    return Tables.from_storage(spark, pipeline_root)


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_store_has_snapshots(stored):
    assert stored.recent_env is not None and stored.recent_occ is not None
    assert stored.env.count() == 6 and stored.occ.count() == 17


@pytest.mark.parametrize("report", [
    lambda t: oc.occupancy_now(t),
    lambda t: oc.occupancy_events(t),
    lambda t: oc.occupancy_history(t).drop("delta_s"),
    lambda t: en.env_summary(t, as_of=AS_OF),
    lambda t: en.env_hourly(t, "24h", as_of=AS_OF),
    lambda t: en.env_score(t),
    lambda t: en.latest_status(t),
    lambda t: da.sector_heatmap(t, as_of=AS_OF).drop("co2_history"),
    lambda t: al.alert_kpis(t, as_of=AS_OF),
])
def test_reports_from_store(stored, gold, report):
    _same(report(stored), report(gold))


def test_hourly_tiles_stream_over_the_store(spark, gold, stored, pipeline_root, tmp_path):
    from roomsense.streaming import hourly
    out = str(tmp_path / "tiles")
    q = hourly.start_hourly(sink.stream_table(spark, pipeline_root, "env_readings"), out, str(tmp_path / "ck_tiles"),
                            available_now=True)
    q.awaitTermination()
    got = [tuple(r) for r in hourly.read_hourly(spark, out, stored.env, "30d", as_of=AS_OF).collect()]
    want = [tuple(r) for r in en.env_hourly(gold, "30d", as_of=AS_OF).collect()]
    assert got == want
