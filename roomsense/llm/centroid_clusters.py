"""Nearest-centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are put in the order of a Hilbert curve through a coarse grid (2 bits a dimension) and cut into blocks of at most
``block_rows`` that carry the least and greatest value of each dimension.  In every round a block's box gives its candidate
centroids (``integers.survivors``: distance bounds of the box), and the block's vectors are compared with these alone, exactly
and vectorised.  Blocks are written once and read by every round.  All arithmetic is on integers floor(scale * x) and exact,
whatever the components' size; vectors too large for exact float64 form blocks without a box, compared with all centroids in
Python integers.

*Scale.*  The order comes from a range partitioning by (key, hash of the row), so a third of all rows on one key still spreads.
Tasks add up their own vectors, sums are added in Spark, and the driver receives at most one row per centroid and dimension.

Kept are vectors of exactly ``dims`` components, none null or non-finite.  The centroids start as the ``k`` kept vectors
with the smallest SHA-256 of ``<seed>:<id>`` (null ids last; ties by the vector), all vectors if there are fewer.  Equal
distances go to the smaller number.  Repeated rows are rows of their own; null ids are clustered like others.  A distance
beyond a long, and a sum over such, is null.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.llm import integers
from roomsense.llm.common import pick, written

BITS = 2


def hilbert_keys(grid: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Positions on the Hilbert curve, as byte strings in the curve's order; ``grid`` has cells 0 ... 2^bits - 1 (rows x dims)."""
    x = np.ascontiguousarray(grid.T.astype(np.int64))   # the transposed form: one bit string over all dimensions
    dims = len(x)
    for level in range(bits - 1, 0, -1):                # undo the rotations and reflections of each level
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            swap = np.where(x[i] & bit, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(x[i] & bit, below, swap)
            x[i] ^= swap
    for i in range(1, dims):                            # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    wide = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)])   # level, dimension, row
    return [key.tobytes() for key in np.packbits(wide.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)]


def _keyed(dims: int, scale: int, span: float):
    """Adds the Hilbert key; vectors that are not exact in float64 get none."""
    def run(batches):
        for batch in batches:
            q, big = integers.quantised(integers.matrix(batch.column("raw"), dims), scale)
            grid = np.clip(np.floor((q / span + 1) * 2 ** (BITS - 1)), 0, 2 ** BITS - 1)
            keys = [None if b else key for b, key in zip(big.tolist(), hilbert_keys(np.where(big[:, None], 0, grid)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), pa.array(keys, pa.binary())], ["id", "raw", "key"])
    return run


def _blocks(dims: int, scale: int, block_rows: int, id_type: pa.DataType, value: pa.DataType):
    """Neighbouring rows as blocks: ids, their values in a row, and the box (null where a vector is not exact in float64)."""
    box = pa.list_(pa.float64())

    def block(rows: pa.Table) -> pa.RecordBatch:
        raw = rows.column("raw").combine_chunks()
        q, big = integers.quantised(integers.matrix(raw, dims), scale)
        low, high = (None, None) if big.any() else (q.min(axis=0), q.max(axis=0))
        ids = rows.column("id").combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(id_type)), pa.array([raw.flatten().to_numpy()], pa.list_(value)),
                                           pa.array([low], box), pa.array([high], box)], ["ids", "raw", "low", "high"])

    def run(batches):
        waiting: dict[bool, list] = {True: [], False: []}   # rows with and without a key
        for batch in batches:
            keyed = batch.column("key").is_valid()
            for kind, mask in ((True, keyed), (False, pc.invert(keyed))):
                rows = pa.Table.from_batches([*waiting[kind], batch.filter(mask)])
                at = 0
                while rows.num_rows - at >= block_rows:
                    yield block(rows.slice(at, block_rows))
                    at += block_rows
                waiting[kind] = rows.slice(at).to_batches()
        for kind in waiting:
            if sum(b.num_rows for b in waiting[kind]):
                yield block(pa.Table.from_batches(waiting[kind]))
    return run


def zone_map(vectors: DataFrame, dims: int, scale: int, block_rows: int) -> DataFrame:
    """``vectors`` (id, raw) as written blocks: ids, raw (the vectors' values one after another), low, high."""
    from pyspark.sql.pandas.types import to_arrow_type

    # the grid spans the middle vector's largest component on both sides, so single outliers do not coarsen it
    widest = vectors.select(F.array_max(F.transform("raw", lambda x: F.abs(x.cast("double")))).alias("m"))
    span = widest.agg(F.percentile_approx("m", 0.5, 1000)).first()[0] or 1.0
    kind, value = vectors.schema["id"].dataType, vectors.schema["raw"].dataType
    span = max(1.0, min(span * scale, integers.limit(dims)))
    keyed = written(vectors.mapInArrow(_keyed(dims, scale, span), f"id {kind.simpleString()}, raw {value.simpleString()}, key binary"), "hilbert-keys")
    order = [F.col("key"), F.xxhash64("id", "raw")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(_blocks(dims, scale, block_rows, to_arrow_type(kind), to_arrow_type(value.elementType)),
                                f"ids array<{kind.simpleString()}>, raw {value.simpleString()}, low array<double>, high array<double>")
    return written(blocks, "blocks")


class Assigner:
    """The centroids of one round, as a task uses them over blocks."""

    def __init__(self, centroids: np.ndarray, scale: int):
        self.entries, self.scale, self.dims = integers.Entries(centroids), scale, centroids.shape[1]
        self.compared = self.blocks = 0

    def assign(self, raw: pa.Array, low, high):
        """(rows, their vectors, centroids, distances) of one block's exact rows and of its large ones."""
        x = raw.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, self.dims)
        q, big = integers.quantised(x, self.scale)
        which = np.arange(len(self.entries))
        if low is not None:
            which = np.nonzero(integers.survivors(np.array([low]), np.array([high]), self.entries)[0])[0]
        self.compared, self.blocks = self.compared + len(which), self.blocks + 1
        easy, hard = np.nonzero(~big)[0], np.nonzero(big)[0]
        if len(easy):
            yield easy, q[easy], *integers.nearest(q[easy], self.entries, which)
        if len(hard):
            v = integers.large(x[hard], self.scale)
            yield hard, v, *integers.nearest(v, self.entries, which)


def _each_block(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("raw")[i].values, batch.column("low")[i].as_py(), batch.column("high")[i].as_py(), batch, i


def train(vectors: DataFrame, blocks: DataFrame, k: int, rounds: int, seed: int, dims: int, scale: int) -> np.ndarray:
    """The centroids after the rounds, as Python integers."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = integers.smallest(vectors.select("id", "raw", code.alias("code")), [F.col("code").asc_nulls_last(), F.col("raw").asc()], k)
    centroids = integers.large(np.array([r["raw"] for r in first], np.float64).reshape(len(first), dims), scale)
    for _ in range(rounds if len(first) else 0):
        def run(batches, centroids=centroids):
            assigner, sums = Assigner(centroids, scale), integers.Sums(len(centroids), dims)
            for raw, low, high, _, _ in _each_block(batches):
                for _, v, at, _ in assigner.assign(raw, low, high):
                    sums.add(v, at)
            yield integers.sums_batch(sums.rows(0))

        centroids = integers.moved(blocks.select("raw", "low", "high").mapInArrow(run, integers.SUMS), [centroids])[0]
    return centroids


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64, id_col: str = "vec_id",
            vector_col: str = "embedding", block_rows: int = 512) -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    rows = pick(vectors, id=id_col, raw=vector_col)
    rows = rows.where(integers.good("raw") & (F.size("raw") == dims)).select("id", integers.components(rows, "raw").alias("raw"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = zone_map(rows, dims, scale, block_rows)
    centroids = train(rows, blocks, k, rounds, seed, dims, scale)

    def run(batches):
        assigner = Assigner(centroids, scale)
        for raw, low, high, batch, i in _each_block(batches):
            n = len(raw) // dims
            number, distance = np.zeros(n, np.int64), np.zeros(n, object)
            for at, _, c, d in assigner.assign(raw, low, high):
                number[at], distance[at] = c, (d if d.dtype == object else d.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(number, pa.int32()),
                                              pa.array(integers.fitting(distance), pa.int64())], ["id", "cluster", "distance"])

    assigned = written(blocks.mapInArrow(run, f"id {kind}, cluster int, distance long"), "assigned")
    totals = assigned.groupBy("cluster").agg(integers.long_sum("distance").alias("inertia"), F.count("*")).collect()   # at most k rows
    sums = [r["inertia"] for r in totals]
    whole = integers.fitting([sum(sums)])[0] if None not in sums else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = vectors.sparkSession.createDataFrame([(r["cluster"], r["inertia"], whole, digests[r["cluster"]]) for r in totals],
                                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(about), "cluster")   # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
