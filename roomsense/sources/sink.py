"""Sinks (S05, S07) and the storage layout read by ``Tables.from_storage``.

Facts are written per micro-batch into ``<root>/<table>/batch_id=<n>/day=<d>``
with overwrite of that batch folder only: replaying a batch rewrites the same
files (idempotent, C8), and a reader sees whole batches.  Readers discover
``batch_id`` and ``day`` as partition columns, so time windows prune days.

Dimension rows (sectors, sensors) are written by the seed and by every feed's
ingest job, so their folders also name the writer:
``<root>/<table>/source=<feed>/batch_id=<n>``; two feeds never overwrite each
other's batch.  ``current_dimension`` keeps one row per key, the earliest
registration (the seed first), as an insert-if-absent table would.
"""

from __future__ import annotations

import datetime
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomsense import schemas
from roomsense.session import ensure_checkpoint_dir
from roomsense.sources.codes import ALERT_CODES, upper_codes

FACT_SCHEMAS = {"env_readings": schemas.ENV_READINGS, "occupancy_readings": schemas.OCCUPANCY_READINGS}
DIM_SCHEMAS = {"sectors": schemas.SECTORS, "sensors": schemas.SENSORS}


DIM_KEYS = {"sectors": "sector_id", "sensors": "sensor_id"}
SEED_SOURCE = "seed"


def _with_partitions(schema: T.StructType, fact: bool, source: bool = False) -> T.StructType:
    fields = list(schema.fields)
    if source:
        fields.append(T.StructField("source", T.StringType(), True))
    fields.append(T.StructField("batch_id", T.LongType(), True))
    if fact:
        fields.append(T.StructField("day", T.DateType(), True))
    return T.StructType(fields)


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def write_batch(df: DataFrame, root: str, table: str, batch_id: int, source: str = SEED_SOURCE) -> dict | None:
    """Append one batch; overwrite of the batch folder keeps replays idempotent.

    For a fact the write itself is observed: rows, the largest id and time, the days, and the pages of the ids.  They are
    kept beside the table (``read_latest``, ``key_batches``) and returned; no row is read again for them."""
    if table in DIM_SCHEMAS:
        out = f"{table_path(root, table)}/source={source}/batch_id={batch_id}"
    else:
        out = f"{table_path(root, table)}/batch_id={batch_id}"
    if table not in FACT_SCHEMAS:
        df.write.mode("overwrite").parquet(out)
        return None
    seen = Observation()
    day = F.to_date("ts")
    # sorted by (sensor, time) inside each day: row-group min/max on
    # sensor_id and ts let per-sensor and time-range reads skip groups
    (df.withColumn("day", day).observe(seen, F.count(F.lit(1)).alias("rows"), F.max("id").alias("max_id"), F.max("ts").alias("latest"),
                                       F.collect_set(day).alias("days"), F.collect_set(id_page()).alias("pages"))
     .sortWithinPartitions("day", "sensor_id", "ts").write.mode("overwrite").partitionBy("day").parquet(out))
    found = seen.get
    write_keys(df.sparkSession, root, table, batch_id, found["pages"], found["days"])
    write_latest(df.sparkSession, root, table, batch_id, found["latest"])
    return found


# -- beside each fact: its newest time, and which batches hold which keys ---------------

#: Ids of one page: a batch of consecutive ids has few pages, and a stored id's batches are found by its page.
PAGE_IDS = 1 << 16
#: Batches whose keys share a file, so a reader opens one small file for so many batches.
KEY_BLOCK = 64
#: A batch with more pages (ids that follow no order) counts as holding any id.
MOST_PAGES = 10_000
KEYS = "batch_id long, pages array<long>, days array<date>"


def id_page(column: str = "id"):
    return F.floor(F.col(column) / F.lit(PAGE_IDS))


def _keys_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/_keys_{table}"


def write_keys(spark: SparkSession, root: str, table: str, batch_id: int, pages, days) -> None:
    """A batch's id pages and days, in one file with those of its block's earlier batches; a replay rewrites its own file."""
    path, block = _keys_path(root, table), batch_id // KEY_BLOCK
    before = newest_complete(spark, path, batch_id)
    rows = []
    if before is not None and before // KEY_BLOCK == block:
        rows = [tuple(r) for r in spark.read.schema(KEYS).parquet(f"{path}/batch_id={before}").collect()]   # at most KEY_BLOCK rows
    rows.append((batch_id, sorted(pages) if len(pages) <= MOST_PAGES else None, sorted(days)))
    spark.createDataFrame(rows, KEYS).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    prune_folders(spark, path, keep_from=batch_id - 2, from_batch=block * KEY_BLOCK)


def _known_keys(spark: SparkSession, root: str, table: str) -> tuple[set[int], DataFrame | None]:
    """Numbers of the stored batches, and the keys of those whose writes have told them: one small file a block."""
    stored = set(batch_numbers(spark, table_path(root, table)))
    path = _keys_path(root, table)
    last: dict[int, int] = {}
    for n in batch_numbers(spark, path, complete=True):
        last[n // KEY_BLOCK] = max(n, last.get(n // KEY_BLOCK, n))
    if not stored or not last:
        return stored, None
    return stored, spark.read.schema(KEYS).parquet(*(f"{path}/batch_id={n}" for n in last.values()))


def key_batches(spark: SparkSession, root: str, table: str, pages: list[int], but: int | None = None) -> list[int]:
    """Stored batches that may hold an id of one of the pages: those whose keys say so and those without known keys."""
    stored, keys = _known_keys(spark, root, table)
    stored -= {but}
    if not stored or keys is None:
        return sorted(stored)
    wanted = spark.createDataFrame([(p,) for p in pages], "page long")
    hit = keys.where("pages is not null").select("batch_id", F.explode("pages").alias("page")).join(F.broadcast(wanted), "page")   # at most MOST_PAGES
    hit = {r[0] for r in hit.select("batch_id").distinct().collect()}
    known = {r[0] for r in keys.where("pages is not null").select("batch_id").collect()}   # one number per stored batch
    return sorted(n for n in stored if n in hit or n not in known)


def day_folders(spark: SparkSession, root: str, table: str, since: datetime.date) -> list[str]:
    """Folders of a fact that hold days from ``since`` on: those that the batches' keys name, and all of a batch without
    known keys.  Their number follows the days asked for, however many batches came before."""
    stored, keys = _known_keys(spark, root, table)
    path, found, known = table_path(root, table), [], set()
    if keys is not None:
        days = F.filter("days", lambda d: d >= F.lit(since))
        known = {r[0] for r in keys.select("batch_id").collect()}   # one number per stored batch
        late = keys.select("batch_id", F.explode(days).alias("day")).distinct().orderBy("batch_id", "day")
        found = [f"{path}/batch_id={r.batch_id}/day={r.day}" for r in late.collect() if r.batch_id in stored]
    return found + [f"{path}/batch_id={n}" for n in sorted(stored - known)]


def write_latest(spark: SparkSession, root: str, table: str, batch_id: int, latest) -> None:
    """the newest reading time after a batch: that of the batches before it or its own."""
    path = f"{root.rstrip('/')}/_latest_{table}"
    before = newest_complete(spark, path, batch_id)
    if before is None and batch_numbers(spark, table_path(root, table)) not in ([], [batch_id]):
        return   # a store filled by other means: its newest time is not known from here
    if before is not None:
        known = spark.read.parquet(f"{path}/batch_id={before}").first()["latest"]
        latest = max([x for x in (known, latest) if x is not None], default=None)
    spark.createDataFrame([(latest,)], "latest timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    prune_folders(spark, path, keep_from=batch_id - 2)


def read_latest(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """One row with the newest stored reading time: one small file; None where no write has told it."""
    path = f"{root.rstrip('/')}/_latest_{table}"
    newest = newest_complete(spark, path)
    return None if newest is None else spark.read.schema("latest timestamp_ntz").parquet(f"{path}/batch_id={newest}")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, deleted when the session ends.  Only a session in one process may leave
    the setting unset (tests)."""
    base = ensure_checkpoint_dir(spark)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        base = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="roomsense-shared-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def _exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system: a path without a scheme is on the cluster's default one."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, root: str, table: str, since: datetime.date | None = None) -> DataFrame:
    """A stored table with its partition columns; empty (typed) if absent.  ``since``: only a fact's days from this one
    on, and only their folders are listed."""
    fact = table in FACT_SCHEMAS
    base = FACT_SCHEMAS.get(table) or DIM_SCHEMAS.get(table)
    schema = _with_partitions(base, fact, source=table in DIM_SCHEMAS)
    path = table_path(root, table)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(schema).option("basePath", path)
    if since is None or not fact:
        return stored.parquet(path)
    folders = day_folders(spark, root, table, since)
    return stored.parquet(*folders).where(F.col("day") >= F.lit(since)) if folders else spark.createDataFrame([], schema)


def batch_numbers(spark: SparkSession, path: str, complete: bool = False) -> list[int]:
    """Numbers of the ``batch_id=`` folders below a path, ascending; ``complete``: only those whose write has committed."""
    if not _exists(spark, path):
        return []
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(x.getPath(), re.fullmatch(r"batch_id=(-?\d+)", x.getPath().getName())) for x in fs.listStatus(p)]
    return sorted(int(m[1]) for folder, m in found
                  if m and (not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))))


def largest_batch(spark: SparkSession, root: str, table: str) -> int | None:
    """Highest batch number that has a folder of a table, complete or not."""
    return max(batch_numbers(spark, table_path(root, table)), default=None)


def newest_file_time(spark: SparkSession, path: str) -> int | None:
    """Latest modification time (ms) of the files in a folder."""
    if not _exists(spark, path):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return max((x.getModificationTime() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if x.isFile()),
               default=None)


def current_dimension(df: DataFrame, table: str) -> DataFrame:
    """One row per key: the earliest registration (seed, then lowest batch,
    then source name).  Dimensions are small and size-checked by Tables."""
    key = DIM_KEYS[table]
    cols = [f.name for f in DIM_SCHEMAS[table].fields]
    rank = F.struct(F.when(F.col("source") == SEED_SOURCE, 0).otherwise(1), F.col("batch_id"), F.col("source"))
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), rank).alias("r")).select("r.*")


def stream_table(spark: SparkSession, root: str, table: str, max_files_per_trigger: int | None = 1000) -> DataFrame:
    """A stored fact table as a file-source stream (new batch folders as they
    commit), with its partition columns; feeds the streaming tiles (I11)."""
    schema = _with_partitions(FACT_SCHEMAS[table], fact=True)
    path = table_path(root, table)
    r = spark.readStream.schema(schema).option("basePath", path)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def read_plain(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """A table stored as one plain parquet folder; empty (typed) if absent."""
    path = table_path(root, table)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


#: Alerts with codes as reports compare them, by the day they fired.  A plain ``alerts`` folder may stand beside it.
ALERTS_BY_DAY = "alerts_by_day"


def write_alerts(df: DataFrame, root: str) -> None:
    """Append alerts: codes are normalised here (C10), once, so that readers push their comparisons to the files."""
    rows = upper_codes(df, ALERT_CODES).withColumn("day", F.to_date("fired_at"))
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(table_path(root, ALERTS_BY_DAY))


def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    """All stored alerts with codes normalised.  Those written by ``write_alerts`` come as stored, with their ``day``
    partitions; those of a plain ``alerts`` folder are normalised as they are read."""
    plain, by_day = (table_path(root, t) for t in ("alerts", ALERTS_BY_DAY))
    schema = T.StructType([*schemas.ALERTS.fields, T.StructField("day", T.DateType(), True)])
    stored = spark.read.schema(schema).option("basePath", by_day).parquet(by_day) if _exists(spark, by_day) else None
    if not _exists(spark, plain):
        return spark.createDataFrame([], schema) if stored is None else stored
    old = upper_codes(spark.read.schema(schemas.ALERTS).parquet(plain), ALERT_CODES)
    return old if stored is None else stored.unionByName(old.withColumn("day", F.to_date("fired_at")))


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def seed_store(root: str, sectors: DataFrame, sensors: DataFrame) -> None:
    """Initial dimension rows of a store (source seed, batch -1)."""
    write_batch(sectors, root, "sectors", -1)
    write_batch(sensors, root, "sensors", -1)


# -- recent snapshots: the newest readings per sensor, one folder per batch ------------

def snapshot_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/recent_{table}"


def write_snapshot(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{snapshot_path(root, table)}/batch_id={batch_id}")


def newest_complete(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """Highest K of the ``path/batch_id=K`` folders whose write has committed
    (Spark's ``_SUCCESS`` marker), optionally below ``before``.  A reader
    never picks a folder that a running batch is still writing."""
    jvm = spark._jvm
    for n in reversed(batch_numbers(spark, path)):
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={n}/_SUCCESS")
        if (before is None or n < before) and mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return n
    return None


def read_snapshot(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame | None:
    """The newest committed snapshot (optionally: the newest older than batch
    ``before``); None when none was written.  Only that one small folder is read."""
    path = snapshot_path(root, table)
    newest = newest_complete(spark, path, before)
    if newest is None:
        return None
    return spark.read.schema(FACT_SCHEMAS[table]).parquet(f"{path}/batch_id={newest}")


#: A folder that a report may have planned on stays this long at least: well above the longest report.
KEEP_SECONDS = 3600


def prune_snapshots(spark: SparkSession, root: str, table: str, keep_from: int, keep_seconds: int = KEEP_SECONDS) -> None:
    """Remove snapshot folders older than batch ``keep_from`` (readers that
    planned against a slightly older snapshot keep working: the newest few stay)."""
    prune_folders(spark, snapshot_path(root, table), keep_from, keep_seconds)


def prune_folders(spark: SparkSession, path: str, keep_from: int, keep_seconds: int = KEEP_SECONDS, from_batch: int | None = None) -> None:
    """Delete ``path/batch_id=K`` folders with (from_batch <=) K < keep_from that are older than ``keep_seconds``."""
    if not _exists(spark, path):
        return
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("batch_id="):
            try:
                bid = int(name.split("=", 1)[1])
            except ValueError:
                continue
            if bid < keep_from and (from_batch is None or bid >= from_batch) and status.getModificationTime() <= (time.time() - keep_seconds) * 1000:
                fs.delete(status.getPath(), True)
