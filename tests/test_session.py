from roomsense.session import apply_sql_conf, cluster_conf


def test_cluster_conf_scales_with_input():
    big = cluster_conf(100e12)
    small = cluster_conf(1e12)
    assert int(big["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) > int(
        small["spark.sql.adaptive.coalescePartitions.initialPartitionNum"])
    assert int(big["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) >= 8000
    assert big["spark.sql.adaptive.enabled"] == "true"


def test_apply_sql_conf_sets_only_sql_keys(spark):
    old = spark.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionFactor")
    try:
        apply_sql_conf(spark, {"spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
                               "spark.decommission.enabled": "true"})
        assert spark.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionFactor") == "4"
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", old)
