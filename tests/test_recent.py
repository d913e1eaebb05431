"""Reports that only look at each sensor's newest readings give the same
result from the recent snapshot as from the whole history."""

import os

import pytest

from roomsense.operators import dashboard as da
from roomsense.operators import environment as en
from roomsense.operators import occupancy as oc
from roomsense.operators import thresholds as th
from roomsense.plans.latest import last_n
from roomsense.sources import fixtures
from roomsense.tables import RECENT_DEPTH
from tests.conftest import AS_OF

SF = "/root/testdata/sf0.01"


def with_snapshots(t):
    snap = lambda df: last_n(df, ["sensor_id"], RECENT_DEPTH, rank="_r").drop("_r")
    return t.replace(recent_env=snap(t.env).cache(), recent_occ=snap(t.occ).cache())


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


REPORTS = [
    lambda t, as_of: oc.occupancy_now(t),
    lambda t, as_of: oc.occupancy_history(t),
    lambda t, as_of: oc.occupancy_events(t),
    lambda t, as_of: en.latest_status(t),
    lambda t, as_of: en.env_score(t),
    lambda t, as_of: en.env_summary(t, as_of=as_of),
    lambda t, as_of: en.env_hourly(t, "7d", as_of=as_of),
    lambda t, as_of: th.status_by_threshold(t),
    lambda t, as_of: da.sector_heatmap(t, as_of=as_of).drop("co2_history"),
    lambda t, as_of: da.dashboard_summary(t, as_of=as_of),
]


@pytest.mark.parametrize("i", range(len(REPORTS)))
def test_golden_snapshot_equals_history(gold, i):
    _same(REPORTS[i](with_snapshots(gold), AS_OF), REPORTS[i](gold, AS_OF))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("i", range(len(REPORTS)))
def test_scale_snapshot_equals_history(spark, i):
    t = fixtures.build(spark, SF)
    _same(REPORTS[i](with_snapshots(t), fixtures.AS_OF), REPORTS[i](t, fixtures.AS_OF))


def test_snapshot_reads_are_small(gold):
    t = with_snapshots(gold)
    plan = oc.occupancy_events(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan
