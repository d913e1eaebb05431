"""The ingest loop — as a Structured Streaming query over landed
feed files (``IngestJob.start``) or as one polling pass (``poll_once``).

Each batch, streamed or polled, goes through ``process``:

1. parse keys and times; invalid rows (missing value, bad time, optional
   8-bit range) go to quarantine (I03, I04);
2. register unknown devices and their sectors (I06, I07), also of rows that
   go to quarantine: a device is known from its first record;
3. keep the first arrival per id, then the lowest id per (sensor, ts), and
   drop what is already stored under either key (I02, C7);
4. write the batch folder with overwrite (C8) and the counters (I08), among
   them the declared constraints that quarantined rows break (I10).

An empty batch writes nothing and is reported as skipped (I05); empty outputs
write no folder.  With ``initial_days`` the first load is a date window over
all files that had landed when the first run started, however the stream cuts
them into batches.  A new checkpoint over a store that already holds batches
numbers its own above them, so nothing stored is overwritten.

In the stream the checkpoint replaces the reference's id mark; a row with an
old event time but a new file is accepted (I09).  Processing-time trigger
60 s in service, ``availableNow`` in tests.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roomsense.operators import constraints
from roomsense.operators import ingest as ops
from roomsense.plans.latest import last_n
from roomsense.sources import landing, sink
from roomsense.tables import RECENT_DEPTH

TABLE_OF = {"env": "env_readings", "occ": "occupancy_readings"}


@dataclass
class IngestJob:
    spark: SparkSession
    store_root: str
    kind: str
    eight_bit: bool = False
    initial_days: int | None = None   # S02: first pass keeps only this date window
    as_of: object = None              # clock of the initial window (default: now)
    keep_seconds: int = sink.KEEP_SECONDS   # age up to which older snapshots stay
    initial_until: int | None = None  # S02: newest file (ms) of the initial load; set by ``start``

    @property
    def table(self) -> str:
        return TABLE_OF[self.kind]

    @staticmethod
    def with_file(raw: DataFrame) -> DataFrame:
        """File of each record (allowed on a stream)."""
        return raw.select("*", F.col("_metadata.file_modification_time").alias("_file_t"),
                          F.col("_metadata.file_name").alias("_file_n"))

    @staticmethod
    def with_arrival(raw: DataFrame) -> DataFrame:
        """Arrival order inside a micro-batch: file (modification time, name),
        then line; a JSON-lines file is read by one task in line order."""
        if "_file_t" not in raw.columns:
            raw = IngestJob.with_file(raw)
        return raw.withColumn(ops.ARRIVAL, F.struct(
            F.col("_file_t").alias("t"), F.col("_file_n").alias("f"),
            F.monotonically_increasing_id().alias("n"))).drop("_file_t", "_file_n")

    def process(self, raw: DataFrame, batch_id: int, window_days: int | None = None) -> dict:
        """One micro-batch of raw feed records -> quarantine, new dimension
        rows, accepted facts, recent snapshot and counters, all in folders of
        ``batch_id`` (overwritten on replay)."""
        spark = self.spark
        if ops.ARRIVAL not in raw.columns:
            raw = self.with_arrival(raw)
        raw = raw.persist()
        try:
            received = raw.count()
            if received == 0:
                return {"batch_id": batch_id, "received": 0, "inserted": 0, "skipped": True}
            parsed = ops.parse_feed(raw, self.kind)
            first_load = F.lit(window_days is not None)
            if window_days is None and self.initial_days is not None:
                # decided per record by the age of its file, not by the batch it happens to be in
                window_days = self.initial_days
                first_load = (F.lit(batch_id == 0) if self.initial_until is None else
                              F.unix_millis(F.col(ops.ARRIVAL)["t"]) <= F.lit(self.initial_until))
            if window_days is not None:
                inside = landing.in_initial_window(window_days, as_of=self.as_of)
                parsed = parsed.where(~first_load | F.col("ts").isNull() | inside)
            good, bad = ops.split_valid(parsed, self.kind, eight_bit=self.eight_bit)
            bad_cols = [c for c in bad.columns if c != ops.ARRIVAL]
            broken = self._write(bad.select(*bad_cols), f"quarantine_{self.kind}", batch_id,
                                 metrics=constraints.observed(self.kind, bad_cols))

            # dimension rows other than this feed's own batch (a replay must
            # not see its own first attempt)
            mine = (F.col("source") == self.kind) & (F.col("batch_id") == batch_id)
            sensors = sink.read_table(spark, self.store_root, "sensors").where(~mine)
            sectors = sink.read_table(spark, self.store_root, "sectors").where(~mine)
            # a device is known from its first record, valid or not
            seen = parsed.where(F.col("sensor_id").between(-128, 127)) if self.eight_bit else parsed
            new_sensors = ops.new_sensors(seen, sensors).persist()
            new_sectors = ops.new_sectors(new_sensors, sectors)
            self._write(new_sensors, "sensors", batch_id, source=self.kind)
            self._write(new_sectors, "sectors", batch_id, source=self.kind)
            new_sensors.unpersist()

            stored = sink.read_table(spark, self.store_root, self.table).where(F.col("batch_id") != batch_id)
            keep = [c for c in good.columns if c not in (ops.ARRIVAL,) and not c.startswith("_")]
            # the persisted records hold all keys of the batch
            span = ops.key_span(good.select("id", "sensor_id", "ts"))
            span.batches = None if span.pages is None else sink.key_batches(spark, self.store_root, self.table, span.pages, but=batch_id)
            accepted = ops.dedupe(good.select(*keep, ops.ARRIVAL), stored, span=span).persist()
            inserted = 0
            if not accepted.isEmpty():
                written = sink.write_batch(accepted, self.store_root, self.table, batch_id)
                inserted = written["rows"]
                self.update_recent(accepted, batch_id)
                self.update_mark(written["max_id"], batch_id)
            accepted.unpersist()
            counters = {"batch_id": batch_id, "received": received, "inserted": inserted}
            counted = {**counters, "broken": [{"constraint": c, "rows": n} for c, n in sorted(broken.items()) if n]}
            spark.createDataFrame([counted], "batch_id long, received long, inserted long, broken array<struct<constraint: string, rows: long>>").write.mode("overwrite").json(
                f"{self.store_root}/_metrics_{self.kind}/batch_id={batch_id}")
            return counters
        finally:
            raw.unpersist()

    def _write(self, df: DataFrame, table: str, batch_id: int, metrics: list | None = None, **where) -> dict:
        """Write a batch's rows; no folder for none.  A replayed batch has the same rows, so it writes or skips alike.
        ``metrics`` are counted by the write itself and returned."""
        if df.isEmpty():
            return {}
        seen = Observation()
        sink.write_batch(df.observe(seen, *metrics) if metrics else df, self.store_root, table, batch_id, **where)
        return seen.get if metrics else {}

    def update_recent(self, accepted: DataFrame, batch_id: int, keep: int = 3) -> None:
        """Newest RECENT_DEPTH readings per sensor: previous snapshot (at most
        depth x sensors rows) merged with this batch's accepted rows.  A replay
        of batch N merges with snapshot N-1 again, so it rewrites the same
        snapshot."""
        prev = sink.read_snapshot(self.spark, self.store_root, self.table, before=batch_id)
        if prev is None:
            # the store may have been filled by other means: a snapshot must cover every stored fact
            stored = sink.read_table(self.spark, self.store_root, self.table).where(F.col("batch_id") != batch_id)
            prev = last_n(stored, ["sensor_id"], RECENT_DEPTH, rank="_rank").select(*accepted.columns)
        merged = prev.unionByName(accepted.select(*prev.columns))
        snap = last_n(merged, ["sensor_id"], RECENT_DEPTH, rank="_rank").drop("_rank")
        sink.write_snapshot(snap, self.store_root, self.table, batch_id)
        sink.prune_snapshots(self.spark, self.store_root, self.table, keep_from=batch_id - keep + 1,
                             keep_seconds=self.keep_seconds)

    def _mark_path(self) -> str:
        return f"{self.store_root.rstrip('/')}/_mark_{self.kind}"

    def update_mark(self, batch_max_id, batch_id: int, keep: int = 3) -> None:
        """S04 kept incrementally: mark_N = max(mark_{N-1}, this batch's max
        accepted id), one tiny file per batch (older ones pruned).  A replay of
        batch N starts again from mark_{N-1}."""
        prev = self.read_mark(before=batch_id)
        mark = max([m for m in (prev, batch_max_id) if m is not None], default=None)
        self.spark.createDataFrame([(mark,)], "mark long").coalesce(1).write.mode("overwrite").parquet(
            f"{self._mark_path()}/batch_id={batch_id}")
        sink.prune_folders(self.spark, self._mark_path(), keep_from=batch_id - keep + 1, keep_seconds=self.keep_seconds)

    def read_mark(self, before: int | None = None):
        """The newest stored mark (None when nothing was stored)."""
        newest = sink.newest_complete(self.spark, self._mark_path(), before)
        if newest is None:
            return None
        return self.spark.read.parquet(f"{self._mark_path()}/batch_id={newest}").first()["mark"]

    def poll_once(self, path: str, batch_id: int, first_pass: bool = False, dias: int = 1) -> dict:
        """One pass of the reference's polling loop in batch form (I01, S02-S04):
        the first pass keeps a date window; later passes keep ids above the
        stored high-water mark and are skipped while the table is empty.
        ``batch_id`` must grow with every pass (it names the output folders);
        re-running a pass with the same ``batch_id`` gives the same store.
        The streaming job needs no mark: its checkpoint records the files taken."""
        records = self.with_arrival(self.with_file(landing.read_feed(self.spark, path, self.kind)))
        if first_pass:
            return self.process(records, batch_id, window_days=dias)
        # the mark as it was before this pass: a replayed pass reads its own
        # rows again and rewrites the same folders
        mark = self.read_mark(before=batch_id)
        if mark is None:
            # a store filled by other means: fall back to max(id) of the facts
            stored = sink.read_table(self.spark, self.store_root, self.table).where(F.col("batch_id") != batch_id)
            mark = stored.agg(F.max("id")).first()[0]
        if mark is None:
            return {"batch_id": batch_id, "received": 0, "inserted": 0, "skipped": True}
        return self.process(landing.incremental(records, mark), batch_id)

    def _note(self, name: str, value: int | None) -> int | None:
        """A number kept beside the store under a name; written if given."""
        path = f"{self.store_root.rstrip('/')}/_run_{self.kind}/{name}"
        if value is not None:
            self.spark.createDataFrame([(value,)], "value long").coalesce(1).write.mode("overwrite").parquet(path)
            return value
        return self.spark.read.parquet(path).first()["value"] if sink._exists(self.spark, path) else None

    def _first_batch(self, checkpoint: str) -> int:
        """Number of a checkpoint's batch 0: above all batches that the store held when the checkpoint was new."""
        name = f"first-{hashlib.sha1(checkpoint.encode()).hexdigest()}"
        if sink._exists(self.spark, f"{checkpoint.rstrip('/')}/offsets"):
            return self._note(name, None) or 0
        largest = sink.largest_batch(self.spark, self.store_root, self.table)
        return self._note(name, 0 if largest is None else largest + 1)

    def _initial_until(self, landing_dir: str) -> int:
        """Age limit (ms) of the initial load's files: the newest that had landed when the first run started."""
        known = self._note("initial-until", None)
        return self._note("initial-until", sink.newest_file_time(self.spark, landing_dir) or 0) if known is None else known

    def start(self, landing_dir: str, checkpoint: str | None = None, available_now: bool = False,
              max_files_per_trigger: int | None = 10_000, period: str = "60 seconds"):
        # max_files_per_trigger bounds each micro-batch (a backlog of landed
        # files is taken in slices, never as one giant batch)
        if checkpoint is None:
            base = self.spark.conf.get("spark.checkpoint.dir", None)
            if not base:
                raise ValueError("no checkpoint location: pass one or set spark.checkpoint.dir")
            checkpoint = f"{base.rstrip('/')}/ingest_{self.kind}"
        first = self._first_batch(checkpoint)
        if self.initial_days is not None:
            self.initial_until = self._initial_until(landing_dir)
        stream = self.with_file(landing.stream_feed(self.spark, landing_dir, self.kind, max_files_per_trigger))
        w = stream.writeStream.foreachBatch(lambda df, bid: self.process(df, first + bid)).option(
            "checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)
        return w.start()


def stored_ids(spark: SparkSession, store_root: str, kind: str) -> list[int]:
    """Test helper: the stored ids of a feed table, sorted."""
    df = sink.read_table(spark, store_root, TABLE_OF[kind])
    return sorted(r.id for r in df.select("id").collect())
