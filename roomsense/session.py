"""Session construction for tests, bench and local runs.

On a cluster the session comes from the platform; only ``ensure_checkpoint_dir``
is meant to be called there, and it never overrides a configured value.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.driver.memory": "8g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "roomsense",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; tests pass ``fallback`` (a fresh temp folder) which is
    used only when the setting is absent.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:   # each call would make a further empty folder
            spark.sparkContext.setCheckpointDir(current)
        return current
    if fallback is None:
        return None
    spark.conf.set("spark.checkpoint.dir", fallback)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def cluster_conf(input_bytes: float = 100e12, executors: int = 1000, cores_per_executor: int = 8,
                 executor_memory_gb: int = 32) -> dict[str, str]:
    """Settings sized for a cluster run (default: 100 TB over 1,000 executors).

    * scan splits of 256 MB (parquet row groups are read whole), so a task's
      input fits comfortably in its share of executor memory;
    * AQE starts from enough shuffle partitions for the largest shuffle we
      plan (the de-dup / DQ key shuffles, about the input size in the worst
      case) at ~256 MB each, then coalesces small ones; skewed partitions
      above 4 x the median and 512 MB are split;
    * automatic broadcast stays bounded (64 MB); explicit broadcasts are
      size-checked by ``plans.joins``;
    * graceful decommissioning migrates shuffle and cached blocks off
      executors that are being lost, so stages need not recompute them.
    """
    slots = executors * cores_per_executor
    target = 256 * 1024 ** 2
    initial = max(slots, int(input_bytes // target))
    per_core_gb = executor_memory_gb / cores_per_executor
    split = 256 * 1024 ** 2 if per_core_gb >= 2 else 128 * 1024 ** 2
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 ** 2),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.exchange.reuse": "true",
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
        "spark.storage.decommission.rddBlocks.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


def apply_sql_conf(spark: SparkSession, conf: dict[str, str]) -> None:
    """Set the runtime-settable (spark.sql.*) entries on a live session; the
    others belong in the cluster's submit configuration."""
    for key, value in conf.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
