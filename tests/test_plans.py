"""Plan-shape guards for the scale properties (read from the physical plan
on the driver's sf0.01 tables)."""

import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(spark, name, run=False):
    df = entry.queries()[name](spark, SF)
    if run:
        df.write.format("noop").mode("overwrite").save()
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _tree(plan):
    return plan.split("\n\n")[0]


def test_last_n_has_partial_limit_below_the_shuffle(spark):
    tree = _tree(_plan(spark, "occupancy_events"))
    lines = tree.splitlines()
    limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    exchanges = [i for i, line in enumerate(lines) if re.search(r"\bExchange\b", line) and "Broadcast" not in line]
    between = [i for i in exchanges if limits[0] < i < limits[1]] if len(limits) == 2 else []
    # final limit above, partial limit below, exactly one shuffle of the readings between them
    assert len(limits) == 2 and len(between) == 1


def test_minutes_of_both_facts_share_one_shuffle(spark):
    tree = _tree(_plan(spark, "co2_people_by_minute"))
    shuffles = [line for line in tree.splitlines() if re.search(r"\bExchange\b", line) and "Broadcast" not in line]
    # the tagged union by (sensor, minute), then its aggregates by (sector, minute); no join but with the dimension
    assert len(shuffles) == 2 and "SortMergeJoin" not in tree
    lines = tree.splitlines()
    union = next(i for i, line in enumerate(lines) if "Union" in line)
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert join < union and sum("HashAggregate" in line for line in lines[join:union]) == 2


def test_dq_report_uses_one_expand_per_table(spark):
    assert _tree(_plan(spark, "dq_report")).count("Expand") >= 2


@pytest.mark.parametrize("name", ["latest_status", "over_capacity", "alerts_from_thresholds", "peak_by_sector"])
def test_dimensions_are_broadcast(spark, name):
    tree = _tree(_plan(spark, name))
    assert "BroadcastHashJoin" in tree and "SortMergeJoin" not in tree


def test_no_python_udfs_anywhere(spark):
    for name in entry.queries():
        plan = _plan(spark, name)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


@pytest.mark.parametrize("name", ["peak_by_sector", "sector_heatmap", "co2_people_by_minute"])
def test_readings_are_reduced_before_they_meet_a_dimension(spark, name):
    """Every join with a dimension has an aggregate of the facts below it on the same branch."""
    lines = _tree(_plan(spark, name)).splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    scans = [i for i, line in enumerate(lines) if "Scan parquet" in line]
    details = _plan(spark, name)
    for i in scans:
        number = re.search(r"\((\d+)\)", lines[i])[1]
        about = details[details.index(f"\n({number}) Scan parquet"):][:600]
        if "events" not in about:
            continue
        above, d = [], depth[i]
        for j in range(i - 1, -1, -1):   # the operators that this scan feeds
            if depth[j] < d:
                above.append(lines[j])
                d = depth[j]
        joins = [k for k, line in enumerate(above) if "Join" in line]
        aggregates = [k for k, line in enumerate(above) if "Aggregate" in line]
        assert not joins or (aggregates and aggregates[0] < joins[0]), (name, above)


def test_stored_alerts_are_pruned_by_day_and_codes_reach_the_files(spark, gold, tmp_path):
    from pyspark.sql import functions as F

    from roomsense.operators import alerts as al
    from roomsense.operators import dashboard as da
    from roomsense.sources import sink
    from roomsense.tables import Tables
    from tests.conftest import AS_OF

    root = str(tmp_path / "store")
    sink.seed_store(root, gold.sectors, gold.sensors)
    gold.thresholds.write.parquet(f"{root}/thresholds")
    messy = gold.alerts.withColumn("severity", F.lower("severity")).withColumn("status", F.concat(F.lit(" "), "status"))
    sink.write_alerts(messy, root)
    t = Tables.from_storage(spark, root).replace(env=gold.env, occ=gold.occ)
    reports = {"odour": lambda x: da.odour_events(x, as_of=AS_OF), "kpis": lambda x: al.alert_kpis(x, as_of=AS_OF),
               "open": al.open_critical_sectors, "list": lambda x: al.alert_list(x, severity="critico", status="ABERTO", as_of=AS_OF),
               "tiles": lambda x: da.sector_heatmap(x, as_of=AS_OF)}
    for name, report in reports.items():
        assert sorted(map(str, report(t).collect())) == sorted(map(str, report(gold).collect())), name

    def scan(name):
        text = spark._jvm.PythonSQLUtils.explainString(reports[name](t)._jdf.queryExecution(), "formatted")
        return [b for b in text.split("\n\n") if "Scan parquet" in b and "alerts_by_day" in b]

    assert "EqualTo(severity,CRITICO)" in scan("list")[0] and "EqualTo(status,ABERTO)" in scan("list")[0]
    assert "EqualTo(severity,CRITICO)" in scan("open")[0] and "EqualTo(parameter,VOC)" in scan("odour")[0]
    for name in ("odour", "kpis", "tiles"):
        assert re.search(r"PartitionFilters: \[.*day", scan(name)[0]), name
    # a plain folder beside it, as older stores have, is read too
    gold.alerts.limit(1).withColumn("alert_id", F.lit(10 ** 9)).write.parquet(f"{root}/alerts")
    assert Tables.from_storage(spark, root).alerts.count() == gold.alerts.count() + 1
