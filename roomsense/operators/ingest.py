"""Ingest operators, batch form (I02-I04, I06-I09).  The streaming driver in
``roomsense.streaming.ingest`` applies them to every micro-batch.

De-duplication rule (C7): keep the lowest arrival per ``id``, then the lowest
``id`` per (sensor_id, ts), then drop rows whose ``id`` or (sensor_id, ts)
is already stored.  Both reductions are aggregates (``min_by``), so copies of
one key are combined map-side; no task ever holds a whole duplicate group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomsense import schemas
from roomsense.plans.joins import DIM_ROW_BOUND
from roomsense.sources import sink

# The known device -> (sector, sensor type) mapping of the
# feed, the fallback for unknown devices, and the defaults of auto-created
# dimension rows.
SENSOR_SECTOR_MAP = {
    1: (1, "MULTISENSOR"),
    2: (3, "HPD2"),
    3: (1, "HPD2"),
    6: (2, "HPD2"),
    7: (5, "HPD2"),
    8: (4, "HPD2"),
}
UNKNOWN_SENSOR = (1, "DESCONHECIDO")
NEW_SECTOR_TYPE = "Geral"
NEW_SECTOR_CAPACITY = 25
ARRIVAL = "_arrival"


def wall_clock(text) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text as TIMESTAMP_NTZ, read without any time zone: 02:30 of a night that skips that hour
    stays 02:30.  NULL for any other text and for days or hours that no calendar has."""
    text = F.col(text) if isinstance(text, str) else text
    text = text.cast("string")
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), text.try_cast("timestamp_ntz"))


def parse_feed(raw: DataFrame, kind: str) -> DataFrame:
    """Rename feed keys to table columns; the time text becomes ``ts`` (``wall_clock``; bad text -> NULL -> quarantine)."""
    mapping = schemas.FEED_ENV_COLUMNS if kind == "env" else schemas.FEED_OCCUPANCY_COLUMNS
    cols = []
    for key, col in mapping.items():
        if key == "data":
            cols.append(wall_clock(key).alias(col))
        else:
            cols.append(F.col(key).alias(col))
    extra = [c for c in raw.columns if c not in mapping]
    return raw.select(*cols, *extra)


def split_valid(df: DataFrame, kind: str, eight_bit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with every required value present (and, optionally,
    8-bit sensor id / people as the reference's TINYINT columns) are accepted;
    the rest go to quarantine with a reason."""
    target = schemas.ENV_READINGS if kind == "env" else schemas.OCCUPANCY_READINGS
    required = [f.name for f in target.fields]
    reason = F.lit(None).cast("string")
    for c in reversed(required):
        reason = F.when(F.col(c).isNull(), F.lit(f"missing {c}")).otherwise(reason)
    if eight_bit:
        small = [c for c in ("sensor_id", "people", "aerosol_still", "aerosol_risk") if c in df.columns]
        for c in small:
            reason = F.when(reason.isNull() & ~F.col(c).between(-128, 127), F.lit(f"out of range {c}")).otherwise(
                reason)
    tagged = df.withColumn("_reason", reason)
    good = tagged.where(F.col("_reason").isNull()).drop("_reason")
    bad = tagged.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return good, bad


def first_per_key(batch: DataFrame, arrival: str = ARRIVAL) -> DataFrame:
    """C7 steps 1-2 inside one batch.

    Step 1 moves whole rows once (hash-partitioned by id).  Step 2 needs only
    keys: the lowest id per (sensor_id, ts) is a hash aggregate over
    fixed-width columns, and the semi-join back on id meets step 1's output
    in its existing partitioning, so only the small key side is shuffled."""
    row = F.struct(*[F.col(c) for c in batch.columns])
    by_id = batch.groupBy("id").agg(F.min_by(row, F.col(arrival)).alias("r")).select("r.*")
    keep = by_id.groupBy("sensor_id", "ts").agg(F.min("id").alias("id")).select("id")
    return by_id.join(keep, "id", "left_semi")


@dataclass
class KeySpan:
    """What a batch's keys can meet in the store: its rows, its days, the pages of its ids, and the stored batches with such pages.

    None for days or batches means any: more than ``MOST_DAYS`` days or ``sink.MOST_PAGES`` pages are not listed."""
    rows: int
    days: list | None
    pages: list | None
    batches: list | None = None

    @property
    def small(self) -> bool:
        return self.rows <= DIM_ROW_BOUND


MOST_DAYS = 1000


def key_span(keys: DataFrame) -> KeySpan:
    """One pass over a (materialised) batch's keys."""
    k = keys.agg(F.count(F.lit(1)).alias("rows"), F.collect_set(F.to_date("ts")).alias("days"), F.collect_set(sink.id_page()).alias("pages")).first()
    return KeySpan(k["rows"], sorted(k["days"]) if len(k["days"]) <= MOST_DAYS else None,
                   sorted(k["pages"]) if len(k["pages"]) <= sink.MOST_PAGES else None)


def drop_stored(batch: DataFrame, target: DataFrame, keys: DataFrame | None = None, span: KeySpan | None = None) -> DataFrame:
    """C7 step 3: drop rows already stored under either key.

    ``keys`` (default: ``batch``) is any frame holding at least the batch's ids and (sensor_id, ts) keys.  With a ``span``
    of these keys the store is pruned before it is read: ids are looked up in the batches that hold their pages, and
    (sensor_id, ts) in the days of the batch, as a set; so one late row adds its day and its batch to the scan, not all
    between.  When the keys are proven few, the store streams past them broadcast (semi-join), so only colliding keys
    survive and the big side is never shuffled; otherwise, and without a span, both sides shuffle on the key.
    Building the plan runs no job.
    """
    by_id, by_key = target.select(*[c for c in ("id", "batch_id") if c in target.columns]), target
    if span is not None and span.batches is not None and "batch_id" in target.columns:
        by_id = by_id.where(F.col("batch_id").isin(span.batches))
    if span is not None and span.days is not None and "day" in target.columns:
        by_key = by_key.where(F.col("day").isin(span.days))
    by_id, by_key = by_id.select("id"), by_key.select("sensor_id", "ts")
    if span is not None and span.small:
        keys = batch if keys is None else keys
        by_id = by_id.join(F.broadcast(keys.select("id").where(F.col("id").isNotNull())), "id", "left_semi")
        by_key = by_key.join(F.broadcast(keys.select("sensor_id", "ts")), ["sensor_id", "ts"], "left_semi")
    return batch.join(by_id, "id", "left_anti").join(by_key, ["sensor_id", "ts"], "left_anti")


def dedupe(batch: DataFrame, target: DataFrame, arrival: str = ARRIVAL, span: KeySpan | None = None) -> DataFrame:
    """I02 insert-ignore as a set operation."""
    firsts = first_per_key(batch, arrival)
    return drop_stored(firsts, target, keys=batch, span=span).drop(arrival)


def sensor_mapping(sensor_id) -> tuple:
    """(sector_id, sensor_type) of a device id, fixed map with fallback."""
    m = F.create_map(*[x for k, (sec, typ) in SENSOR_SECTOR_MAP.items()
                       for x in (F.lit(k).cast("bigint"), F.struct(F.lit(sec).cast("bigint").alias("sector_id"),
                                                                   F.lit(typ).alias("sensor_type")))])
    hit = F.try_element_at(m, sensor_id)
    sector = F.coalesce(hit.getField("sector_id"), F.lit(UNKNOWN_SENSOR[0]).cast("bigint"))
    typ = F.coalesce(hit.getField("sensor_type"), F.lit(UNKNOWN_SENSOR[1]))
    return sector, typ


def new_sensors(telemetry: DataFrame, sensors: DataFrame, installed_at=None) -> DataFrame:
    """Devices seen in telemetry (rows later quarantined included) and
    absent from ``sensors``, as new sensor rows ('SENSOR_{id}', mapped sector
    and type).  Distinct ids are taken first, so the anti-join sees one row per
    device."""
    ids = telemetry.select("sensor_id").where("sensor_id is not null").distinct().join(sensors.select("sensor_id"), "sensor_id", "left_anti")
    sector, typ = sensor_mapping(F.col("sensor_id"))
    when = F.localtimestamp() if installed_at is None else installed_at
    return ids.select("sensor_id", F.concat(F.lit("SENSOR_"), F.col("sensor_id").cast("string")).alias("sensor_code"),
                      typ.alias("sensor_type"), sector.alias("sector_id"), when.alias("installed_at"),
                      F.lit(1).alias("active"))


def new_sectors(new_sensor_rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sectors referenced by new sensors and missing -> 'Setor {id}' of
    type Geral with the table defaults (capacity 25, active 1)."""
    ids = new_sensor_rows.select("sector_id").distinct().join(sectors.select("sector_id"), "sector_id", "left_anti")
    return ids.select("sector_id", F.concat(F.lit("Setor "), F.col("sector_id").cast("string")).alias("sector_name"),
                      F.lit(NEW_SECTOR_TYPE).alias("sector_type"), F.lit(None).cast("string").alias("floor"),
                      F.lit(NEW_SECTOR_CAPACITY).alias("max_capacity"), F.lit(1).alias("active"))
