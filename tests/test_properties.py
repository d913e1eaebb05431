"""Property tests against brute force on small random inputs: the C7
de-duplication rule and the properties of Q12's events."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from roomsense import schemas
from roomsense.operators import ingest as ops
from roomsense.operators import occupancy as oc
from roomsense.sources import seed
from roomsense.tables import Tables

T0 = dt.datetime(2026, 1, 1)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

row = st.tuples(st.integers(1, 8), st.integers(1, 3), st.integers(0, 5))   # id, sensor, minute


def _expected_dedupe(batch, stored):
    first_by_id = {}
    for arrival, (i, s, m) in enumerate(batch):
        first_by_id.setdefault(i, (arrival, s, m))
    by_key = {}
    for i, (_, s, m) in sorted(first_by_id.items()):
        by_key.setdefault((s, m), i)
    stored_ids = {i for i, _, _ in stored}
    stored_keys = {(s, m) for _, s, m in stored}
    return sorted((i, s, m) for (s, m), i in by_key.items() if i not in stored_ids and (s, m) not in stored_keys)


@SETTINGS
@given(batch=st.lists(row, min_size=1, max_size=14), stored=st.lists(row, max_size=5))
def test_dedupe_matches_row_rule(spark, batch, stored):
    b = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), s, a) for a, (i, s, m) in enumerate(batch)],
                              "id long, ts timestamp_ntz, sensor_id long, _arrival long")
    t = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), s) for i, s, m in stored],
                              "id long, ts timestamp_ntz, sensor_id long")
    got = sorted((r.id, r.sensor_id, int((r.ts - T0).total_seconds() // 60)) for r in ops.dedupe(b, t).collect())
    assert got == _expected_dedupe(batch, stored)


def _check_events(got, counts, capacity):
    """What SURVEY's Q12 row asks of a counter's events, as properties: newest first, at most six, only changes among the
    twelve newest readings, none left out, alarm from 80 % of capacity on; a counter at rest gives one quiet row."""
    recent = counts[-12:]
    steps = [(b - a, b) for a, b in zip(recent, recent[1:], strict=False) if a != b]
    if not counts:
        assert got == []
    elif not steps:
        assert got == [(0, counts[-1], "NORMAL")]
    else:
        assert [(change, people) for change, people, _ in got] == steps[::-1][:6]
        assert all((status == "ALERTA") == (5 * people >= 4 * capacity) for _, people, status in got)


@SETTINGS
@given(counts=st.lists(st.integers(0, 12), min_size=0, max_size=16), capacity=st.integers(5, 15))
def test_events_have_the_asked_properties(spark, counts, capacity):
    occ = spark.createDataFrame(
        [(k + 1, T0 + dt.timedelta(minutes=k), 3, 60, c, 0.0, 0.0, 0.0) for k, c in enumerate(counts)],
        schemas.OCCUPANCY_READINGS)
    sectors = spark.createDataFrame([(1, "S", "UTI", None, capacity, 1)], schemas.SECTORS)
    sensors = seed.sensors(spark).where("sensor_id = 3")
    t = Tables(sectors=sectors, sensors=sensors, env=occ.limit(0), occ=occ, thresholds=seed.thresholds(spark),
               alerts=seed.alerts(spark, T0).limit(0))
    got = [(r.change, r.people, r.status) for r in oc.occupancy_events(t, sector_id=1).orderBy("pos").collect()]
    _check_events(got, counts, capacity)
