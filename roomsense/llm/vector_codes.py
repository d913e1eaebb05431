"""Product-quantisation codes of vectors, with memoised grid cells.

A vector is cut into equal parts; each part position has a codebook whose entries start as that part of the first
vectors by id and move to the floor of their parts' mean in every round.  All arithmetic is on integers
floor(scale * x) and exact, whatever the components' size.

*Memoised cells.*  A part lies in a cell of a coarse grid.  For each cell seen, a task remembers the entries that are not
dominated across the cell's box: an entry falls if its distance exceeds that of the entry nearest to the centre
throughout the box.  (The difference of two squared distances is linear, so its least value over a cube follows from the
centre and the entries' city-block distance; whatever least against greatest distance rules out falls too.)  The parts
of the cell are compared with the others alone, exactly.  The memory is a hash table of at most ``most_cells`` cells a part position (32 bytes
each for 256 entries); cells beyond it are computed for their batch and not kept.  Parts too large for exact float64, and
cells with entries of that kind, are compared with all entries in Python integers.

*Scale.*  Nothing but codebooks travels: a task adds up its own parts, the sums are added in Spark, and the driver
receives at most one row per entry and component.  Labels are joined back by broadcast where they are proven few, else by
a salted join.

Vectors that are null, empty or hold null or non-finite components are dropped, and so are vectors of any length but the
commonest (ties: the longer).  Where that length is no multiple of ``parts``, the first parts are one component longer.
Null ids are coded like others and come after all ids; ties by the vector, smaller components first.  Repeated rows are
rows of their own.  With fewer rows than entries the codebooks are shorter.  An error beyond a long is null.  An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.llm import integers
from roomsense.llm.common import pick, written

#: Up to so many labels are broadcast.
FEW_LABELS = 100_000


def part_ends(dims: int, parts: int) -> list[int]:
    """Where the parts end: equal, or the first ones longer by one."""
    return np.cumsum([0] + [dims // parts + (i < dims % parts) for i in range(parts)]).tolist()


class Cells:
    """The codebook of one part position with its memory of grid cells."""

    def __init__(self, entries: integers.Entries, side: float, most: int = 1 << 16):
        self.entries, self.side, self.most = entries, side, most
        self.memory: dict[bytes, np.ndarray] = {}
        self.apart = np.array([np.abs(entries.near - e).sum(axis=1) for e in entries.near])
        self.hits = self.asked = self.pairs = self.rows = 0

    def _left(self, cells: np.ndarray) -> np.ndarray:
        """cells x entries: those not farther than the entry nearest to the centre throughout the cell."""
        e, half = self.entries, (self.side - 1) / 2
        d = e.norm - 2 * ((cells * self.side + half) @ e.near.T)   # the centre's own norm is common to all
        pivot = d.argmin(axis=1)
        slack = integers.MARGIN * (e.norm + e.norm[pivot][:, None] + np.abs(d))
        return d - d[np.arange(len(d)), pivot][:, None] - 2 * half * self.apart[pivot] <= slack

    def _masks(self, cells: np.ndarray) -> np.ndarray:
        """cells x entries: the entries to compare."""
        keys = [c.tobytes() for c in cells]
        out = np.empty((len(cells), -(-len(self.entries) // 8)), np.uint8)
        new = []
        for i, key in enumerate(keys):
            found = self.memory.get(key)
            if found is None:
                new.append(i)
            else:
                out[i] = found
        for at in range(0, len(new), 2048):
            some = new[at:at + 2048]
            out[some] = np.packbits(self._left(cells[some]), axis=1)
        for i in new:
            if len(self.memory) < self.most:
                self.memory[keys[i]] = out[i].copy()
        self.asked, self.hits = self.asked + len(keys), self.hits + len(keys) - len(new)
        return np.unpackbits(out, axis=1, count=len(self.entries)).astype(bool)

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part (float64 holding integers within ``integers.limit``)."""
        n = len(v)
        code, error = np.zeros(n, np.int64), np.zeros(n, object)
        if not n or not v.shape[1]:
            return code, error
        grid = np.floor(v / self.side).astype(np.int32)
        _, first, cell = np.unique(grid.view(f"V{grid.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
        masks = self._masks(grid[first])
        exact = (masks & ~self.entries.small).any(axis=1)[cell]
        if exact.any():
            code[exact], error[exact] = integers.nearest(v[exact], self.entries, np.arange(len(self.entries)))
        easy = np.nonzero(~exact)[0]
        width = masks.sum(axis=1)[cell[easy]]
        self.pairs, self.rows = self.pairs + int(width.sum()), self.rows + len(easy)
        ends = np.cumsum(width)
        at = 0
        while at < len(easy):   # about 2^17 pairs at a time
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), side="right")))
            rows = easy[at:stop]
            row, entry = np.nonzero(masks[cell[rows]])
            d = v[rows][row] - self.entries.near[entry]
            d = np.einsum("ij,ij->i", d, d)
            start = np.concatenate([[0], np.cumsum(width[at:stop])[:-1]])
            least = np.minimum.reduceat(d, start)
            best = np.nonzero(d == least[row])[0]   # in order of row, then entry
            _, one = np.unique(row[best], return_index=True)
            code[rows], error[rows] = entry[best[one]], least.astype(np.int64)
            at = stop
        return code, error


class Coder:
    """All parts' codebooks, as one task uses them."""

    def __init__(self, books: list[np.ndarray], ends: list[int], side: float, scale: int, most_cells: int):
        self.ends, self.scale, self.dims = ends, scale, ends[-1]
        self.books = [Cells(integers.Entries(b), side, most_cells) for b in books]

    def parts(self, raw: pa.Array):
        """For each part position: rows that are exact in float64 with their parts, and the other rows with theirs."""
        x = integers.matrix(raw, self.dims)
        q, big = integers.quantised(x, self.scale)
        easy, hard = np.nonzero(~big)[0], np.nonzero(big)[0]
        more = integers.large(x[hard], self.scale)
        for p, (a, b) in enumerate(zip(self.ends, self.ends[1:], strict=False)):
            # contiguous copies: cells are hashed by their bytes
            yield p, easy, np.ascontiguousarray(q[easy, a:b]), hard, more[:, a:b]

    def assign(self, raw: pa.Array):
        """For each part position (rows, parts, entries, errors), once for the easy and once for the hard rows."""
        for p, easy, v, hard, w in self.parts(raw):
            if len(easy):
                yield p, easy, v, *self.books[p].assign(v)
            if len(hard):
                yield p, hard, w, *integers.nearest(w, self.books[p].entries, np.arange(len(self.books[p].entries)))


def _side(books: list[np.ndarray]) -> float:
    """The cells' side: a power of two, about half a standard deviation of the first entries' components, without outliers."""
    values = np.abs(np.concatenate([integers.Entries(b).near.ravel() for b in books]))
    middle = float(np.median(values)) if len(values) else 0.0   # of a centred normal: 0.67 standard deviations
    return float(2 ** int(np.clip(np.ceil(np.log2(max(1.0, 0.75 * middle))), 0, 40)))


def train(rows: DataFrame, dims: int, parts: int, codes: int, rounds: int, scale: int, most_cells: int, side: float | None) -> tuple:
    """(codebooks, ends, side) after the rounds; ``rows``: id, raw."""
    ends = part_ends(dims, parts)
    first = integers.smallest(rows.select("id", "raw"), [F.col("id").asc_nulls_last(), F.col("raw").asc()], codes)
    whole = integers.large(np.array([r["raw"] for r in first], np.float64).reshape(len(first), dims), scale)
    books = [whole[:, a:b] for a, b in zip(ends, ends[1:], strict=False)]
    side = side or _side(books)
    for _ in range(rounds if len(first) else 0):
        def run(batches, books=books):
            coder = Coder(books, ends, side, scale, most_cells)
            sums = [integers.Sums(len(b), b.shape[1]) for b in books]
            for batch in batches:
                for p, _, v, code, _ in coder.assign(batch.column(0)):
                    sums[p].add(v, code)
            yield integers.sums_batch([r for p, s in enumerate(sums) for r in s.rows(p)])

        books = integers.moved(rows.select("raw").mapInArrow(run, integers.SUMS), books)
    return books, ends, side


def books_sha256(books: list[np.ndarray]) -> str:
    """Of the entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()


def _label_totals(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of its errors over equal labels; nulls are one label."""
    totals = written(coded.groupBy("label").agg(integers.long_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if totals.count() <= FEW_LABELS:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = totals.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(31))))
    lanes = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(32)).cast("int"))
    return lanes.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("lane"))).drop("of", "lane", "salt")


def compress(vectors: DataFrame, parts: int = 4, codes: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label", most_cells: int = 1 << 16, side: float | None = None) -> DataFrame:
    """``id_col``, code (hex, two digits a part), error, label_error and codebooks_sha256 of every kept row; at most 256 ``codes``."""
    rows = pick(vectors, id=id_col, raw=vector_col, label=label_col)
    rows = rows.where(integers.good("raw")).select("id", "label", integers.components(rows, "raw").alias("raw"))
    rows = written(rows, "vectors")
    kind, label = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    length = rows.groupBy(F.size("raw").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = length["dims"] if length else parts
    rows = rows.where(F.size("raw") == dims)
    books, ends, side = train(rows, dims, parts, codes, rounds, scale, most_cells, side)

    def run(batches):
        coder = Coder(books, ends, side, scale, most_cells)
        for batch in batches:
            n = batch.num_rows
            code, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, object)
            for p, at, _, entry, d in coder.assign(batch.column("raw")):
                code[at, p] = entry
                error[at] += integers.as_ints(d) if d.dtype == object else d.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()),
                                              pa.array(integers.fitting(error), pa.int64())], ["id", "label", "code", "error"])

    coded = written(rows.mapInArrow(run, f"id {kind}, label {label}, code string, error long"), "coded")
    out = _label_totals(coded).withColumn("codebooks_sha256", F.lit(books_sha256(books)))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
