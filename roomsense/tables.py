"""The six tables a report reads, plus the size checks of the dimensions and
the optional per-sensor "recent readings" snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomsense.plans.joins import DIM_ROW_BOUND, fits_broadcast, maybe_broadcast

TABLE_NAMES = ("sectors", "sensors", "env", "occ", "thresholds", "alerts")
STORAGE_NAMES = {
    "sectors": "sectors",
    "sensors": "sensors",
    "env": "env_readings",
    "occ": "occupancy_readings",
    "thresholds": "thresholds",
    "alerts": "alerts",
}

# Readings per sensor kept by the recent snapshots: the deepest per-sensor
# report is Q04 (last 20); Q12 needs 12, the latest-reading reports 1.
RECENT_DEPTH = 20


@dataclass
class Tables:
    """``recent_env`` / ``recent_occ``, when given, hold at least the newest
    ``RECENT_DEPTH`` readings of every sensor (the ingest job maintains them,
    one small snapshot per micro-batch).  Reports that only look at a
    sensor's newest readings then read the snapshot — O(sensors) rows — instead
    of the whole history; their results are identical either way."""

    sectors: DataFrame
    sensors: DataFrame
    env: DataFrame
    occ: DataFrame
    thresholds: DataFrame
    alerts: DataFrame
    recent_env: DataFrame | None = None
    recent_occ: DataFrame | None = None
    env_latest: DataFrame | None = None   # one row: the newest environment reading's time
    dim_row_bound: int = DIM_ROW_BOUND
    _small: dict = field(default_factory=dict, repr=False)

    def is_small(self, name: str) -> bool:
        """Row-count check of a dimension, run once per Tables instance."""
        if name not in self._small:
            self._small[name] = fits_broadcast(getattr(self, name), self.dim_row_bound)
        return self._small[name]

    def dim(self, name: str) -> DataFrame:
        return maybe_broadcast(getattr(self, name), self.is_small(name))

    def sensor_sector(self) -> DataFrame:
        """sensor -> (sector, name, type, capacity); inner join, so sensors whose
        sector does not exist drop out exactly as the reference's joins do."""
        sec = self.dim("sectors").select("sector_id", "sector_name", "sector_type", "max_capacity")
        joined = self.sensors.select("sensor_id", "sector_id").join(sec, "sector_id", "inner")
        # bounded by the sensors row count, checked above
        return maybe_broadcast(joined, self.is_small("sensors") and self.is_small("sectors"))

    # -- newest readings per sensor -------------------------------------------------

    def env_newest(self, depth: int = 1) -> DataFrame:
        """Environment rows containing every sensor's newest ``depth`` readings."""
        if self.recent_env is not None and depth <= RECENT_DEPTH:
            return self.recent_env
        return self.env

    def occ_newest(self, depth: int = 1) -> DataFrame:
        """Occupancy rows containing every sensor's newest ``depth`` readings."""
        if self.recent_occ is not None and depth <= RECENT_DEPTH:
            return self.recent_occ
        return self.occ

    def latest_env_time(self) -> Column:
        """max(ts) of the environment readings (scalar subquery): from the mark
        that every write leaves (one small file), else from the snapshot, else
        from the newest day partition."""
        from roomsense.plans.windows import latest_time
        if self.env_latest is not None:
            return self.env_latest.select(F.max("latest")).scalar()
        return latest_time(self.env_newest())

    def anchor(self, as_of=None) -> Column:
        """latest environment reading time, else ``as_of``."""
        from roomsense.plans.windows import as_of_col
        return F.coalesce(self.latest_env_time(), as_of_col(as_of))

    def replace(self, **frames) -> "Tables":
        names = TABLE_NAMES + ("recent_env", "recent_occ", "env_latest")
        values = {n: getattr(self, n) for n in names}
        if "env" in frames:
            values["env_latest"] = None   # told of the rows replaced
        values.update(frames)
        return Tables(**values, dim_row_bound=self.dim_row_bound)

    @classmethod
    def from_storage(cls, spark: SparkSession, root: str, since=None) -> "Tables":
        """Read the layout written by ``roomsense.sources.sink`` and the ingest
        job: facts with ``batch_id`` / ``day`` partitions, dimensions, and the
        newest recent snapshots when present.  ``since`` (``window_start``): the
        first day the facts are read from; folders of days before are not listed."""
        from roomsense import schemas
        from roomsense.sources import sink
        from roomsense.sources.codes import THRESHOLD_CODES, upper_codes
        frames = {
            "sectors": sink.current_dimension(sink.read_table(spark, root, "sectors"), "sectors"),
            "sensors": sink.current_dimension(sink.read_table(spark, root, "sensors"), "sensors"),
            "env": sink.read_table(spark, root, "env_readings", since),
            "occ": sink.read_table(spark, root, "occupancy_readings", since),
            "thresholds": upper_codes(sink.read_plain(spark, root, "thresholds", schemas.THRESHOLDS),
                                      THRESHOLD_CODES),
            "alerts": sink.read_alerts(spark, root),
            "recent_env": sink.read_snapshot(spark, root, "env_readings"),
            "recent_occ": sink.read_snapshot(spark, root, "occupancy_readings"),
            "env_latest": sink.read_latest(spark, root, "env_readings"),
        }
        return cls(**frames)


def window_start(spark: SparkSession, root: str, days: int, as_of=None):
    """First day of a window of ``days`` that ends at the anchor or at ``as_of``, whichever is earlier; None (all days)
    where the store does not tell its newest reading."""
    from roomsense.plans import windows
    from roomsense.sources import sink
    latest = sink.read_latest(spark, root, "env_readings")
    if latest is None:
        return None
    end = F.least(F.max("latest"), windows.as_of_col(as_of))
    return latest.select(F.to_date(end - windows.days(days))).first()[0]
