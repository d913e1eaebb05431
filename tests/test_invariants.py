"""SURVEY §5 invariants and C6 tie rules."""

import datetime as dt

import pytest

from roomsense import schemas
from roomsense.operators import alerts as al
from roomsense.operators import compliance as co
from roomsense.operators import dashboard as da
from roomsense.operators import environment as en
from roomsense.operators import occupancy as oc
from tests.conftest import AS_OF

WINDOWED = [
    lambda t: en.env_summary(t, as_of=AS_OF),
    lambda t: en.env_hourly(t, "30d", as_of=AS_OF),
    lambda t: en.peak_by_sector(t, as_of=AS_OF),
    lambda t: co.compliance(t, "30d", as_of=AS_OF),
    lambda t: en.env_score(t),
    lambda t: en.latest_status(t),
    lambda t: oc.occupancy_now(t),
    lambda t: oc.occupancy_events(t),
    lambda t: da.sector_heatmap(t, as_of=AS_OF).drop("co2_history"),
    lambda t: al.alert_kpis(t, as_of=AS_OF),
]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _old_env(spark):
    # readings two years before every window, for sensor 1, with extreme values
    rows = [(1000 + i, dt.datetime(2024, 1, 1, 0, i), 1, 60, 0.0, 99.0, 40.0, 999.0, 5000.0, 0.0, 99.0, 0, 0, 0.0)
            for i in range(5)]
    return spark.createDataFrame(rows, schemas.ENV_READINGS)


def _old_occ(spark):
    rows = [(1000 + i, dt.datetime(2024, 1, 1, 0, i), 3, 60, 99, 0.0, 0.0, 0.0) for i in range(5)]
    return spark.createDataFrame(rows, schemas.OCCUPANCY_READINGS)


@pytest.mark.parametrize("i", range(len(WINDOWED)))
def test_old_readings_change_nothing(spark, gold, i):
    older = gold.replace(env=gold.env.unionByName(_old_env(spark)), occ=gold.occ.unionByName(_old_occ(spark)))
    assert _rows(WINDOWED[i](older)) == _rows(WINDOWED[i](gold))


@pytest.mark.parametrize("i", range(len(WINDOWED)))
def test_input_order_changes_nothing(gold, i):
    shuffled = gold.replace(env=gold.env.repartition(5).orderBy("co2"), occ=gold.occ.repartition(7),
                            alerts=gold.alerts.repartition(3))
    assert _rows(WINDOWED[i](shuffled)) == _rows(WINDOWED[i](gold))


def test_c6_latest_tie_takes_higher_id(spark, gold):
    t = dt.datetime(2026, 1, 15, 11, 30)
    extra = spark.createDataFrame([(7, t, 1, 60, 0.0, 30.0, 18.0, 100.0, 500.0, 0.0, 40.0, 0, 0, 0.0)],
                                  schemas.ENV_READINGS)
    r = en.env_score(gold.replace(env=gold.env.unionByName(extra))).first()
    # id 7 and id 6 share the newest time; (ts, id) descending picks id 7
    assert (r.co2, r.voc) == (500.0, 100.0)


def test_c6_peak_tie_takes_lower_name(spark, gold):
    # a reading in sector 2 (sensor 6 is its counter; add an env sensor there) equal to the CO2 peak
    sensors = gold.sensors.unionByName(spark.createDataFrame(
        [(9, "ENV-B", "MULTISENSOR", 2, dt.datetime(2025, 1, 1), 1)], schemas.SENSORS))
    extra = spark.createDataFrame([(8, dt.datetime(2026, 1, 15, 6, 0), 9, 60, 0.0, 30.0, 18.0, 100.0, 1100.0, 0.0,
                                    40.0, 0, 0, 0.0)], schemas.ENV_READINGS)
    t = gold.replace(env=gold.env.unionByName(extra), sensors=sensors)
    r = en.peak_by_sector(t, as_of=AS_OF).first()
    # both sectors peak at 1100; 'Sala de Espera - Triagem' < 'UTI Adulto - Ala A'
    assert (r.co2_peak_sector, r.co2_peak_value) == ("Sala de Espera - Triagem", 1100.0)
