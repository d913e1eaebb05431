"""The declared constraints as data, compiled into one pass over each table.

``DECLARED`` lists what the schema promises: NOT NULL columns, 8-bit and text-length ranges, allowed words, keys and
references.  ``violations`` compiles a table's constraints into one aggregate: row-level constraints become 0/1 flags,
references a flag from a left join with the (size-checked) dimension, and all keys one grouping-sets aggregate, so copies of
a key combine before the shuffle.  Totals of the flags come out of the first key's sets, so no further pass is needed.
``observed`` gives the row-level constraints as metrics of a write (``Observation``), which counts them without a scan.

One limit per (sector type, parameter) is not in the schema, but the look-ups rely on it, and the seed rows break it.
A NULL breaks NOT NULL alone: ranges, words, references and keys speak of values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomsense.operators.quality import ALERT_SEVERITIES, ALERT_STATUSES, ENV_REQUIRED, OCC_REQUIRED
from roomsense.tables import STORAGE_NAMES, Tables


@dataclass(frozen=True)
class Constraint:
    """One rule of one table (named as in ``Tables``): ``kind`` over ``columns``, with the kind's further values."""
    table: str
    kind: str              # not_null | range | length | words | unique | reference
    columns: tuple[str, ...]
    values: tuple = ()     # range: (low, high); length: (most,); words: the words; reference: (table, column)

    @property
    def name(self) -> str:
        return f"{self.kind}({', '.join(self.columns)})"

    def broken(self) -> Column:
        """True where a row breaks a row-level constraint."""
        c = F.col(self.columns[0])
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "range":
            return F.coalesce(~c.between(*self.values), F.lit(False))
        if self.kind == "length":
            return F.coalesce(F.char_length(c) > self.values[0], F.lit(False))
        return F.coalesce(~c.isin(*self.values), F.lit(False))


def _rules(table: str, required: list[str], keys: list[tuple[str, ...]], small: tuple[str, ...] = (), lengths: dict | None = None,
           words: dict | None = None, references: dict | None = None) -> list[Constraint]:
    return [*(Constraint(table, "not_null", (c,)) for c in required),
            *(Constraint(table, "range", (c,), (-128, 127)) for c in small),
            *(Constraint(table, "length", (c,), (n,)) for c, n in (lengths or {}).items()),
            *(Constraint(table, "words", (c,), tuple(v)) for c, v in (words or {}).items()),
            *(Constraint(table, "unique", k) for k in keys),
            *(Constraint(table, "reference", (c,), r) for c, r in (references or {}).items())]


SENSOR, SECTOR = ("sensors", "sensor_id"), ("sectors", "sector_id")
READING_KEYS = [("id",), ("sensor_id", "ts")]
# The declared schema's columns, lengths, ranges, words, keys and references.
DECLARED: list[Constraint] = [
    *_rules("sectors", ["sector_id", "sector_name", "sector_type"], [("sector_id",)], ("active",),
            {"sector_name": 100, "sector_type": 50, "floor": 20}),
    *_rules("sensors", ["sensor_id", "sensor_code", "sensor_type", "sector_id", "installed_at"], [("sensor_id",)], ("sensor_id", "active"),
            {"sensor_code": 100, "sensor_type": 30}, references={"sector_id": SECTOR}),
    *_rules("env", ENV_REQUIRED, READING_KEYS, ("sensor_id", "aerosol_still", "aerosol_risk"), references={"sensor_id": SENSOR}),
    *_rules("occ", OCC_REQUIRED, READING_KEYS, ("sensor_id", "people"), references={"sensor_id": SENSOR}),
    *_rules("thresholds", ["threshold_id", "sector_type", "parameter", "critical_limit", "unit"],
            [("threshold_id",), ("sector_type", "parameter")], lengths={"sector_type": 50, "parameter": 30, "unit": 10}),
    *_rules("alerts", ["alert_id", "sensor_id", "sector_id", "parameter", "measured", "limit_ref", "unit", "severity", "status", "fired_at"],
            [("alert_id",)], ("sensor_id",), {"parameter": 30, "unit": 10, "severity": 20, "status": 20},
            {"status": ALERT_STATUSES, "severity": ALERT_SEVERITIES}, {"sensor_id": SENSOR, "sector_id": SECTOR}),
]


def of(table: str, rules: list[Constraint] | None = None) -> list[Constraint]:
    return [c for c in (DECLARED if rules is None else rules) if c.table == table]


def _flagged(t: Tables, table: str, rules: list[Constraint]) -> tuple[DataFrame, list[str], list[Constraint]]:
    """The keys' columns and a 0/1 flag per row-level constraint and reference."""
    rows = getattr(t, table)
    keys = list(dict.fromkeys(c for r in rules if r.kind == "unique" for c in r.columns))
    flags = [r for r in rules if r.kind != "unique"]
    used = list(dict.fromkeys([*keys, *(c for r in flags for c in r.columns)]))
    rows, marks = rows.select(*used), {}
    for i, r in enumerate(flags):
        if r.kind == "reference":
            other, key = r.values
            side = t.dim(other).select(F.col(key).alias(f"_k{i}"), F.lit(True).alias(f"_known{i}")).dropDuplicates([f"_k{i}"])
            rows = rows.join(F.broadcast(side) if t.is_small(other) else side, F.col(r.columns[0]) == F.col(f"_k{i}"), "left")
            marks[i] = F.col(r.columns[0]).isNotNull() & F.col(f"_known{i}").isNull()
        else:
            marks[i] = r.broken()
    return rows.select(*keys, *(marks[i].cast("int").alias(f"_f{i}") for i in range(len(flags)))), keys, flags


def violations(t: Tables, table: str, rules: list[Constraint] | None = None) -> DataFrame:
    """(table_name, constraint, violations) of one table, every constraint a row, from one scan of the table."""
    rules = of(table, rules)
    rows, keys, flags = _flagged(t, table, rules)
    unique = [r for r in rules if r.kind == "unique"]
    sets = [list(r.columns) for r in unique]
    grouped = rows.groupingSets(sets, *keys) if len(sets) > 1 else rows.groupBy(*keys)
    level = F.grouping_id() if len(sets) > 1 else F.lit(0)
    g = grouped.agg(F.count(F.lit(1)).alias("_n"), *(F.sum(f"_f{i}").alias(f"_f{i}") for i in range(len(flags))), level.alias("_set"))

    def bits(columns) -> int:   # grouping_id: a bit for each key column that a set leaves out, the first column's highest
        return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in columns) if len(sets) > 1 else 0

    first = F.col("_set") == bits(sets[0])
    totals = [F.sum(F.when(first, F.col(f"_f{i}"))).alias(f"_t{i}") for i in range(len(flags))]
    copies = []
    for k, r in enumerate(unique):
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in r.columns])
        copies.append(F.sum(F.when((F.col("_set") == bits(r.columns)) & known, F.col("_n") - 1)).alias(f"_u{k}"))
    total = g.agg(*totals, *copies)
    names = [(r.name, f"_t{i}") for i, r in enumerate(flags)] + [(r.name, f"_u{k}") for k, r in enumerate(unique)]
    return total.select(F.inline(F.array(*(F.struct(F.lit(STORAGE_NAMES[table]).alias("table_name"), F.lit(name).alias("constraint"),
                                                    F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations")) for name, c in names))))


def constraint_report(t: Tables, rules: list[Constraint] | None = None) -> DataFrame:
    """Every constraint of every table with its violations."""
    tables = dict.fromkeys(c.table for c in (DECLARED if rules is None else rules))
    return reduce(DataFrame.unionByName, [violations(t, table, rules) for table in tables])


def observed(table: str, columns: list[str], rules: list[Constraint] | None = None) -> list[Column]:
    """Row-level constraints over the columns at hand as metrics, named as the constraints."""
    return [F.count_if(r.broken()).alias(r.name) for r in of(table, rules) if r.kind not in ("unique", "reference") and r.columns[0] in columns]
