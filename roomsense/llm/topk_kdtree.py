"""Exact top-k by integer inner product, with one KD-tree per shard.

Vectors become integers floor(256 * x).  They are dealt to shards by place: a top-level tree of median splits, fitted on the
``sample_rows`` vectors of the smallest hashes, cuts the space into at most ``most_cells`` cells, and a cell of many rows
is dealt to shards of about ``shard_rows`` rows by the hash of id and vector, so equal vectors cannot make a hot shard.  Every row is
in one cell; the sample decides where the cuts lie, never a result.  Each cell has a tight box over all its rows.

A task builds its shard's KD-tree once: nodes split at the median of the widest dimension and carry tight bounding boxes.
A query visits nodes best first: the largest inner product that a box allows is sum(max(q * low, q * high)), and a node is
opened only while that bound can still reach the query's kth best score.  Ties go to the smaller id, so a node whose bound
equals the kth score is opened too.

The kth score travels: every query is first answered in one shard of the cell with the greatest bound.  Its kth score there
rules out, before anything is shuffled, the cells whose boxes cannot reach it, and is the threshold in the shards of the others.
Queries are sent in blocks of at most about ``block_rows`` rows to a shard, so no task holds all queries or all candidates;
each (block, shard) gives at most k rows a query, and these are reduced before the shuffle to the final ranking.

Scores are exact: where all partial sums of a query's scores in a shard are below 2^53, float64 holds them; otherwise
bounds get a margin for rounding and the scores that may count are taken in whole numbers.  A score among the best that is
beyond a long fails.

Vectors that are null or hold null or non-finite components take no part; vectors of another length than the query's are
not candidates for it.  Equal rows (same id and vector) count once; a query never meets rows with its own id.  A null id
is neither query nor candidate.  Empty tables give empty results; further columns are ignored.  The driver holds the sample
and, for each vector length, the boxes of the cells.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from roomsense.llm.common import pick, written

SCALE = 256.0
#: Sums of products below this are exact in float64.
EXACT = 2.0 ** 53


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, margin: bool) -> np.ndarray:
    """For each row of ``q`` and each box the largest inner product that the box allows; ``margin`` covers float64's rounding."""
    out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    if margin:
        out += _rounding(q.shape[1]) * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return out


def _rounding(dims: int) -> float:
    """More than the relative error, against the sum of the products' sizes, of an inner product of rounded integers."""
    return (dims + 1) * 2.0 ** -50


# ------------------------------------------------------------------ the tree of a shard

class KDTree:
    """Median splits over the rows of ``v`` (int64); boxes are kept per node."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf_rows: int = 256):
        x = v.astype(np.float64)
        self.nodes: list[tuple[int, int, int, int]] = []   # first row, last row + 1, left child, right child
        low_of, high_of = [], []
        order = np.arange(len(ids))
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            rows = x[order[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            here = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            low_of.append(low)
            high_of.append(high)
            if parent >= 0:
                first, last, left, right = self.nodes[parent]
                self.nodes[parent] = (first, last, here, right) if side == 0 else (first, last, left, here)
            spread = high - low
            if b - a > leaf_rows and spread.max(initial=0) > 0:   # equal rows need no split
                middle = (a + b) // 2
                along = rows[:, int(spread.argmax())]
                order[a:b] = order[a:b][np.argpartition(along, middle - a)]
                stack += [(middle, b, here, 1), (a, middle, here, 0)]
        self.ids, self.v, self.x = ids[order], v[order], x[order]
        self.low, self.high = np.array(low_of), np.array(high_of)
        self.most = float(np.abs(x).max(initial=0))

    def exact(self, q: np.ndarray) -> np.ndarray:
        """For each row of ``q``: float64 holds all its scores and bounds here."""
        return np.abs(q).max(axis=1, initial=0) * self.most * q.shape[1] < EXACT

    def scores(self, a: int, b: int, q: np.ndarray, whole: np.ndarray, exact: bool, least: float) -> list[tuple[int, int]]:
        """(row, score) of the rows a .. b whose scores are ``least`` or more."""
        near = self.x[a:b] @ q
        if exact:
            return [(a + i, int(near[i])) for i in np.nonzero(near >= least)[0].tolist()]
        near += _rounding(len(q)) * (np.abs(self.x[a:b]) @ np.abs(q))
        rows = a + np.nonzero(near >= least)[0]
        found = zip(rows.tolist(), (self.v[rows].astype(object) * whole.astype(object)).sum(axis=1), strict=True)
        return [(i, s) for i, s in found if s >= least]

    def top(self, query_id: int, q: np.ndarray, whole: np.ndarray, exact: bool, bounds: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, id) of score ``least`` or more, but for the query's own id; best first.  ``q`` and ``whole`` are
        the query as float64 and as integers."""
        best: list[tuple[int, int]] = []   # a heap whose first is the worst kept: (score, -id)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < least:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= least:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            for row, score in self.scores(a, b, q, whole, exact, least):
                item = (score, -int(self.ids[row]))
                if -item[1] == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    least = max(least, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


# ------------------------------------------------------------------ cells of the space

def split_cells(v: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Median splits of sampled vectors along the widest dimension of each part, down to ``cells`` parts (rounded up to a
    power of two): dimension and cut of each inner node, the children of node i at 2i + 1 and 2i + 2."""
    inner = 2 ** (max(1, cells) - 1).bit_length() - 1
    dim, cut = np.zeros(inner, np.int64), np.zeros(inner, np.int64)
    parts = [np.arange(len(v))]
    for node in range(inner):
        rows = v[parts[node]]
        if len(rows) > 1:
            x = rows.astype(np.float64)
            dim[node] = int((x.max(axis=0) - x.min(axis=0)).argmax())
            cut[node] = np.sort(rows[:, dim[node]])[(len(rows) - 1) // 2]
        right = rows[:, dim[node]] > cut[node]
        parts += [parts[node][~right], parts[node][right]]
    return dim, cut


def cell_of(v: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dim, cut = tree
    node = np.zeros(len(v), np.int64)
    for _ in range(len(dim).bit_length()):
        node = 2 * node + 1 + (v[np.arange(len(v)), dim[node]] > cut[node])
    return (node - len(dim)).astype(np.int32)


def _lengths(batch: pa.RecordBatch | pa.Table):
    """(length, places, vectors as int64) of each vector length in a batch with columns dims and v."""
    dims = batch.column("dims").to_numpy()
    for n in np.unique(dims).tolist():
        at = np.nonzero(dims == n)[0]
        yield n, at, _matrix(batch.column("v").take(pa.array(at)), n)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dims)


def _dealt(trees):
    """Adds the cell to rows (id, v, dims)."""
    def run(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for n, at, v in _lengths(batch):
                if n in trees.value:
                    cell[at] = cell_of(v, trees.value[n])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])
    return run


def _boxes(batches):
    """(dims, cell, v) -> dims, cell, n, low, high of a task's rows."""
    found: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        for dims, at, v in _lengths(batch):
            for cell in np.unique(cells[at]).tolist():
                rows = v[cells[at] == cell]
                n, low, high = found.get((dims, cell), (0, rows[0], rows[0]))
                found[dims, cell] = n + len(rows), np.minimum(low, rows.min(axis=0)), np.maximum(high, rows.max(axis=0))
    cols = [[k[0] for k in found], [k[1] for k in found], *([x[i] for x in found.values()] for i in range(3))]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["dims", "cell", "n", "low", "high"])


def cell_boxes(rows: DataFrame) -> dict[int, dict]:
    """For each vector length its cells with their numbers of rows and their boxes: ``cell``, ``n``, ``low``, ``high``."""
    parts = rows.select("dims", "cell", "v").mapInArrow(_boxes, "dims int, cell int, n long, low array<long>, high array<long>")
    # by component, so that a cell's boxes combine before their shuffle however many tasks met it
    wide = parts.select("dims", "cell", "n", F.posexplode_outer(F.arrays_zip("low", "high")).alias("place", "box"))
    wide = wide.groupBy("dims", "cell", "place").agg(F.sum("n").alias("n"), F.min("box.low").alias("low"), F.max("box.high").alias("high"))
    out: dict[int, dict] = {}
    for (dims, cell), box in wide.toPandas().sort_values("place").groupby(["dims", "cell"]):
        found = out.setdefault(int(dims), {"cell": [], "n": [], "low": [], "high": []})
        found["cell"].append(int(cell))
        found["n"].append(int(box["n"].iloc[0]))
        for side in ("low", "high"):
            found[side].append(box[side].to_numpy(np.float64)[:dims])
    return {d: {k: np.array(x).reshape(len(x), d) if k in ("low", "high") else x for k, x in f.items()} for d, f in out.items()}


def _routes(boxes, best_only: bool):
    """Adds to queries the cells whose boxes reach ``least``, or the cell of the greatest bound alone."""
    def run(batches):
        for batch in batches:
            cells: list[list[int]] = [[] for _ in range(batch.num_rows)]
            least = batch.column("least").to_pylist()
            for n, places, v in _lengths(batch):
                found = boxes.value[n]
                for a in range(0, len(places), 1024):
                    bounds = box_bounds(v[a:a + 1024].astype(np.float64), found["low"], found["high"], True)
                    for i, bound in zip(places[a:a + 1024].tolist(), bounds, strict=True):
                        reach = [int(bound.argmax())] if best_only else np.nonzero(bound >= (-np.inf if least[i] is None else least[i]))[0].tolist()
                        cells[i] = [found["cell"][j] for j in reach]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])
    return run


def routed(queries: DataFrame, boxes, parts: DataFrame, best_only: bool) -> DataFrame:
    """Queries (id, v, dims, least, ...) once for each shard (cell, part) that they ask."""
    kind = StructType([*queries.schema.fields, StructField("cells", ArrayType(IntegerType()))])
    asked = queries.mapInArrow(_routes(boxes, best_only), kind).withColumn("cell", F.explode("cells")).drop("cells")
    asked = asked.join(F.broadcast(parts), ["dims", "cell"])   # a row for each vector length and cell
    part = F.pmod(F.xxhash64("id", "v", F.lit(1)), "parts").cast("int")
    return asked.withColumn("part", part if best_only else F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


# ------------------------------------------------------------------ the search

def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dims): each valid row once, components as floor(256 * x)."""
    rows = pick(vectors, id=id_col, raw=vector_col).select(F.col("id").cast("long").alias("id"), F.col("raw").cast("array<double>").alias("raw"))
    good = F.col("id").isNotNull() & F.col("raw").isNotNull() & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(good, F.lit(False)))
    # floor() saturates at a long; larger components would give scores beyond a long in any case
    return rows.select("id", F.transform("raw", lambda x: F.floor(x * SCALE).cast("long")).alias("v"), F.size("raw").alias("dims")).distinct()


PARTIAL = "query_id long, vec_id long, score long"


def _search(k: int):
    """Candidates of one shard on the left, a block of queries on the right."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()
            tree = KDTree(left.column("id").to_numpy(), _matrix(left.column("v"), dims))
            q_ids, whole = right.column("q_id").to_pylist(), _matrix(right.column("q_v"), dims)
            least = [-np.inf if x is None else x for x in right.column("least").to_pylist()]
            for at in range(0, len(whole), 256):
                q = whole[at:at + 256].astype(np.float64)
                exact = tree.exact(q)
                bounds = box_bounds(q, tree.low, tree.high, not exact.all())
                for i in range(len(q)):
                    found = tree.top(q_ids[at + i], q[i], whole[at + i], bool(exact[i]), bounds[i], k, least[at + i])
                    out += [(q_ids[at + i], n, s) for s, n in found]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})
    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192,
          block_rows: int = 4096, sample_rows: int = 8192, most_cells: int = 512) -> DataFrame:
    """Rows for which ``is_query`` (a function of the id column) holds, against all rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, id_col, vector_col), "vectors")
    sizes = {r["dims"]: r["n"] for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}   # one row per vector length
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).collect():
        sample.setdefault(r["dims"], []).append(r["v"])
    trees = {d: split_cells(np.array(v, np.int64).reshape(len(v), d), min(most_cells, -(-sizes[d] // shard_rows), max(1, len(v) // 8)))
             for d, v in sample.items() if d and sizes[d] > shard_rows}
    context = spark.sparkContext
    dealt = rows.mapInArrow(_dealt(context.broadcast(trees)), "id long, v array<long>, dims int, cell int")
    dealt = written(dealt, "cells")
    found = cell_boxes(dealt)
    boxes = context.broadcast(found)   # most_cells boxes for each vector length
    parts = written(spark.createDataFrame([(d, c, -(-n // shard_rows)) for d, f in found.items() for c, n in zip(f["cell"], f["n"], strict=True)],
                                          "dims int, cell int, parts int"), "parts")
    candidates = dealt.join(F.broadcast(parts), ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), "parts").cast("int"))
    queries = rows.where(is_query(F.col("id")))
    blocks = max(1, -(-queries.count() // block_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int"))
    shard = ["dims", "cell", "part"]

    def search(asked: DataFrame) -> DataFrame:
        """A shard is repeated for each block that asks it."""
        pairs = asked.select(*shard, "block").distinct()
        have = candidates.join(pairs, shard).select(*shard, "block", "id", "v")
        asked = asked.select(*shard, "block", "id", "v", "least").toDF("q_dims", "q_cell", "q_part", "q_block", "q_id", "q_v", "least")
        return have.groupBy(*shard, "block").cogroup(asked.groupBy("q_dims", "q_cell", "q_part", "q_block")).applyInArrow(_search(k), PARTIAL)

    home = written(routed(queries.withColumn("least", F.lit(None).cast("long")), boxes, parts, True), "homes")
    first = written(search(home), "home-hits")
    kth = first.distinct().groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    known = home.drop("least").withColumnsRenamed({"cell": "home_cell", "part": "home_part"}).join(kth, F.col("id") == F.col("query_id"), "left").drop("query_id")
    others = written(routed(known, boxes, parts, False).where("cell <> home_cell or part <> home_part"), "asked-shards")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = first.unionByName(search(others)).distinct()   # a repeated id with several vectors asks more than once
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids, vectors, is_query, k: int = 5) -> pd.DataFrame:
    """The same by full scan, for tests."""
    x = np.floor(np.asarray(vectors, dtype=np.float64) * SCALE).astype(np.int64)
    out = []
    for i, n in enumerate(ids):
        if is_query(n):
            scores = x @ x[i]
            order = sorted((-int(s), int(m)) for s, m in zip(scores, ids, strict=True) if m != n)[:k]
            out += [(int(n), r + 1, m, -s) for r, (s, m) in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
