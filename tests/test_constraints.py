"""The declared constraints: every one is broken by the fixture, counted alike by hand, and NULLs break NOT NULL alone."""

import os

import pytest

from roomsense.operators import constraints as cn
from roomsense.sources import fixtures
from tests.conftest import golden

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_the_broken_fixture_breaks_every_constraint(spark):
    rows = cn.constraint_report(fixtures.broken(fixtures.build(spark, "/root/testdata/sf0.01"))).collect()
    assert len(rows) == len(cn.DECLARED)
    assert [(r.table_name, r.constraint) for r in rows if r.violations == 0] == []


def test_sound_tables_break_none_but_the_seed_s_repeated_limits(spark):
    t = golden(spark)
    found = [tuple(r) for r in cn.constraint_report(t).where("violations > 0").collect()]
    assert found == [("thresholds", "unique(sector_type, parameter)", t.thresholds.count() - t.thresholds.select("sector_type", "parameter").distinct().count())]


def test_counts_by_hand(spark):
    t = golden(spark)
    rows = [(1, "S1", "X", 1, None, 1), (1, "S1b", "X", 2, None, 1), (None, None, "X" * 31, 9, None, 300), (None, "S3", "X", None, None, None), (200, "S4", "X", 1, None, -200)]
    sensors = spark.createDataFrame([], t.sensors.schema).unionByName(
        spark.createDataFrame(rows, "sensor_id long, sensor_code string, sensor_type string, sector_id long, installed_at timestamp_ntz, active int"))
    sectors = t.sectors.where("sector_id <= 2").unionByName(t.sectors.where("sector_id = 2"))   # a key twice must not multiply rows
    got = {r.constraint: r.violations for r in cn.violations(t.replace(sensors=sensors, sectors=sectors), "sensors").collect()}
    assert got == {"not_null(sensor_id)": 2, "not_null(sensor_code)": 1, "not_null(sensor_type)": 0, "not_null(sector_id)": 1, "not_null(installed_at)": 5,
                   "range(sensor_id)": 1, "range(active)": 2, "length(sensor_code)": 0, "length(sensor_type)": 1, "unique(sensor_id)": 1, "reference(sector_id)": 1}


def test_one_scan_and_one_expand_per_table(spark):
    t = golden(spark)
    for table, expands in (("env", 1), ("thresholds", 1), ("sensors", 0)):
        df = cn.violations(t, table)
        tree = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split("\n\n")[0]
        assert tree.count("Expand") == expands


def test_rules_are_data(spark):
    t = golden(spark)
    rules = [cn.Constraint("env", "unique", ("sensor_id",)), cn.Constraint("env", "range", ("co2",), (0, 899))]
    got = {r.constraint: r.violations for r in cn.constraint_report(t, rules).collect()}
    assert got == {"unique(sensor_id)": 5, "range(co2)": t.env.where("co2 > 899").count()}
