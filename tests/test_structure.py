"""
with the number of sectors; reports read only the columns they use."""

import os

import pytest

import __spark_entry__ as entry

SFS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def _jobs(spark, name, sf):
    sc = spark.sparkContext
    df = entry.queries()[name](spark, sf)
    group = f"structure-{name}-{sf}"
    sc.setJobGroup(group, group)
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


@pytest.mark.skipif(not all(os.path.isdir(s) for s in SFS), reason="driver test data not present")
def test_heatmap_jobs_do_not_grow_with_sectors(spark):
    counts = [_jobs(spark, "sector_heatmap", sf) for sf in SFS]
    assert counts[0] == counts[1], counts


@pytest.mark.skipif(not os.path.isdir(SFS[1]), reason="driver test data not present")
def test_scans_read_only_needed_columns(spark):
    plan = spark._jvm.PythonSQLUtils.explainString(
        entry.queries()["compliance"](spark, SFS[1])._jdf.queryExecution(), "formatted")
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema") and "event_id" in line]
    assert schemas and all("user_id" not in s and "event_type" not in s for s in schemas)
