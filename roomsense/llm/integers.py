"""Exact arithmetic on integer vectors: quantising, nearest entries, sums, and which entries a box leaves to compare.

Vectors are matrices of float64 that hold integers small enough for every squared distance to be exact, or, beyond that,
matrices of Python integers (dtype object).  All results are exact in both forms; the second is only slower.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMB_BITS = 40
LONGEST = (1 << 63) - 1
FAR = 10 ** 150
#: Relative allowance of bounds for rounding.
MARGIN = 1e-9
SUMS = "part int, code int, dim int, limb int, value long"


def limit(dims: int) -> float:
    """Components up to this have squared distances (and their terms) of at most 2^52."""
    return float(np.floor(np.sqrt(2.0 ** 50 / max(1, dims))))


def good(raw: str) -> Column:
    """True for vectors that are not null and hold at least one component and finite ones only."""
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(raw).isNotNull() & (F.size(raw) > 0) & fine, F.lit(False))


def components(vectors: DataFrame, raw: str) -> Column:
    """The vector column as doubles; floats stay floats, which are half the size."""
    return F.col(raw) if vectors.schema[raw].dataType.simpleString() == "array<float>" else F.col(raw).cast("array<double>")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column whose lists all have ``dims`` values, as float64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def quantised(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as float64, and which rows are too large for that (``large`` gives those).  ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        q = np.floor(x * scale)
    return q, np.abs(q).max(axis=1, initial=0) > limit(x.shape[1])


def large(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers."""
    out = np.empty(x.shape, dtype=object)
    for at, value in np.ndenumerate(x):
        out[at] = int(value) * scale if abs(value) >= 2.0 ** 52 else int(np.floor(value * scale))
    return out


def as_ints(v: np.ndarray) -> np.ndarray:
    return v if v.dtype == object else v.astype(np.int64).astype(object)


class Entries:
    """Centroids or codebook entries: exact integers, and the same as float64 for bounds."""

    def __init__(self, exact: np.ndarray):
        self.exact = exact   # dtype object, entries x dims
        # components beyond +-10^150 are moved there: still farther than anything a box of exact rows can hold
        self.near = np.array([[float(max(-FAR, min(FAR, x))) for x in row] for row in exact], np.float64).reshape(exact.shape)
        self.small = np.abs(self.near).max(axis=1, initial=0) <= limit(exact.shape[1])
        self.norm = (self.near * self.near).sum(axis=1)

    def __len__(self) -> int:
        return len(self.exact)


def survivors(low: np.ndarray, high: np.ndarray, entries: Entries) -> np.ndarray:
    """boxes x entries: False only for entries that are not nearest, nor tied for it, anywhere in the box.

    An entry falls if its least distance to the box exceeds the greatest distance of another, or if it is farther than
    the entry with the least greatest distance throughout the box (the difference of two squared distances is linear,
    so its minimum over a box is at a corner).  Both keep a margin, as float64 only approximates large entries.
    """
    lo, hi, c = low[:, None, :], high[:, None, :], entries.near[None]
    near = np.maximum(np.maximum(lo - c, c - hi), 0.0)
    far = np.maximum(np.abs(c - lo), np.abs(hi - c))
    far = (far * far).sum(axis=2)
    keep = (near * near).sum(axis=2) * (1 - MARGIN) <= far.min(axis=1)[:, None] * (1 + MARGIN)
    pivot = far.argmin(axis=1)
    w = c - entries.near[pivot][:, None, :]
    inner = (np.maximum(w, 0) * hi + np.minimum(w, 0) * lo).sum(axis=2)
    norm = entries.norm[None], entries.norm[pivot][:, None]
    return keep & (norm[0] - norm[1] - 2 * inner <= MARGIN * (norm[0] + norm[1] + np.abs(inner)))


def distances(v: np.ndarray, entries: Entries, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` to the entries numbered ``which``."""
    if v.dtype != object and entries.small[which].all():
        e = entries.near[which]
        return (v * v).sum(axis=1)[:, None] - 2 * (v @ e.T) + entries.norm[which]
    d = as_ints(v)[:, None, :] - entries.exact[which][None]
    return (d * d).sum(axis=2)


def nearest(v: np.ndarray, entries: Entries, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest entry among ``which`` (ascending); ties to the smaller number."""
    d = distances(v, entries, which)
    at = d.argmin(axis=1).astype(np.int64)
    return which[at], d[np.arange(len(d)), at]


class Sums:
    """Componentwise sums and counts of the rows assigned to each entry; exact at any size."""

    def __init__(self, entries: int, dims: int):
        self.count, self.total, self.beyond = np.zeros(entries, np.int64), np.zeros((entries, dims), np.int64), {}

    def add(self, v: np.ndarray, code: np.ndarray) -> None:
        self.count += np.bincount(code, minlength=len(self.count))
        if v.dtype == object:
            for row, c in zip(v, code.tolist(), strict=True):
                self.beyond[c] = row + self.beyond.get(c, 0)
            return
        for j in range(v.shape[1]):   # exact in float64: a batch holds far fewer than 2^25 rows
            self.total[:, j] += np.bincount(code, v[:, j], minlength=len(self.count)).astype(np.int64)

    def rows(self, part: int) -> list[tuple[int, int, int, int, int]]:
        """(part, entry, dim, limb, value): the sums as numbers in base 2^LIMB_BITS whose limbs are longs; dim -1 has the counts."""
        out = []
        for c in np.nonzero(self.count)[0].tolist():
            out.append((part, c, -1, 0, int(self.count[c])))
            out += [(part, c, j, 0, x) for j, x in enumerate(self.total[c].tolist())]
        for c, row in self.beyond.items():
            for j, x in enumerate(row):
                limb = 0
                while not -(1 << LIMB_BITS) <= x < 1 << LIMB_BITS:
                    out.append((part, c, j, limb, x & ((1 << LIMB_BITS) - 1)))
                    x >>= LIMB_BITS
                    limb += 1
                out.append((part, c, j, limb, x))
        return out


def sums_batch(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "code", "dim", "limb", "value"])


def moved(partial: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The entries of each book replaced by floor(sum / count) of their rows; those without rows stay.

    ``partial`` (SUMS, one set per task) is added up in Spark; what comes back has at most one row per entry, dimension and limb.
    """
    total = partial.groupBy("part", "code", "dim", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums: dict[tuple[int, int], dict[int, int]] = {}
    for r in total.collect():
        of = sums.setdefault((r["part"], r["code"]), {})
        of[r["dim"]] = of.get(r["dim"], 0) + (int(r["value"]) << (LIMB_BITS * r["limb"]))
    books = [b.copy() for b in books]
    for (part, code), of in sums.items():
        for j in range(books[part].shape[1]):
            books[part][code, j] = of.get(j, 0) // of[-1]
    return books


def fitting(values) -> list[int | None]:
    """Integers as longs; null beyond a long."""
    return [int(x) if -LONGEST <= x <= LONGEST else None for x in values]


def long_sum(column: str) -> Column:
    """The sum of a long column as a long; null where a value is null or the sum is beyond a long."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when((F.count(column) == F.count("*")) & (F.abs(total) <= F.lit(LONGEST).cast("decimal(38,0)")), total).cast("long")


def smallest(rows: DataFrame, order: list[Column], k: int, lanes: int = 512) -> list:
    """The first ``k`` rows in an order.  Each task keeps k, the tasks' rows meet in lanes, and at most lanes * k reach the end."""
    lane = rows.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    ranked = lane.withColumn("rank", F.row_number().over(Window.partitionBy("lane").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).drop("lane", "rank").orderBy(*order).limit(k).collect()
