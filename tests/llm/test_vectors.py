"""Vector codes and centroid clusters against plain integer arithmetic."""

import hashlib

import numpy as np
import pytest

from roomsense.llm import centroid_clusters, integers, vector_codes

BAD = [(7001, None, 1), (7002, [], 1), (7003, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (7004, [float("nan")] * 8, 2),
       (7005, [float("-inf")] + [0.0] * 7, None), (7006, [1.0, 2.0], 1)]
SCHEMA = "vec_id long, embedding array<double>, label int, LABEL2 string, id long, Raw int"


def table(spark, rows, partitions=5):
    return spark.createDataFrame([(*r, "x", -1, 0) for r in rows], SCHEMA).repartition(partitions)


def vectors(n=300, dims=8, seed=3, huge=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, dims))
    x = np.round(centres[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, dims)), 3)
    x[40:60] = x[0]            # equal vectors
    rows = [(i if i != 17 else None, x[i].tolist(), int(i % 4) if i % 5 else None) for i in range(n)]
    if huge:
        rows += [(n, [1e30] * dims, 1), (n + 1, [-3e5] * dims, None), (-1, [2.0 ** 40] + [0.0] * (dims - 1), 2), (n + 2, [1e300] * dims, 3)]
    return rows + rows[:3]     # repeated rows


def exact(row, scale):
    out = []
    for x in row:
        a, b = x.as_integer_ratio()
        out.append(a * scale // b)
    return out


def lloyd(points, first, rounds):
    """Entries after the rounds, and the last assignment as (entry, squared distance); all in Python integers."""
    entries = [list(points[i]) for i in first]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), n) for n, e in enumerate(entries)) for p in points]

    for _ in range(rounds):
        found = nearest()
        for n in range(len(entries)):
            mine = [p for p, (_, m) in zip(points, found, strict=True) if m == n]
            if mine:
                entries[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return entries, [(n, d) for d, n in nearest()]


def long(x):
    return x if abs(x) < 2 ** 63 else None


def codes_by_hand(rows, parts, codes, rounds, scale=1024):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:codes]
    ends = vector_codes.part_ends(len(rows[0][1]), parts)
    points = [exact(r[1], scale) for r in rows]
    done = [lloyd([p[a:b] for p in points], order, rounds) for a, b in zip(ends, ends[1:], strict=False)]
    digest = hashlib.sha256(",".join(str(x) for entries, _ in done for e in entries for x in e).encode()).hexdigest()
    errors = [long(sum(found[i][1] for _, found in done)) for i in range(len(rows))]
    totals = {}
    for r, e in zip(rows, errors, strict=True):
        totals.setdefault(r[2], []).append(e)
    totals = {k: long(sum(v)) if None not in v else None for k, v in totals.items()}
    return [(r[0], "".join(f"{found[i][0]:02x}" for _, found in done), errors[i], totals[r[2]], digest) for i, r in enumerate(rows)]


def same(got, want):
    def key(r):
        return tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("huge", [False, True])
@pytest.mark.parametrize("side", [None, 4.0, 4096.0])
def test_codes_equal_brute_force(spark, huge, side):
    rows = vectors(huge=huge)
    got = vector_codes.compress(table(spark, rows + BAD), parts=4, codes=20, rounds=3, side=side)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    same(got.collect(), codes_by_hand(rows, 4, 20, 3))


def test_cells_are_remembered_and_prune():
    rng = np.random.default_rng(1)
    entries = integers.Entries(rng.integers(-400, 400, (64, 4)).astype(object))
    v = rng.integers(-400, 400, (3000, 4)).astype(float)
    want = integers.nearest(v, entries, np.arange(64))
    for most in (1 << 16, 10):
        cells = vector_codes.Cells(entries, 128.0, most)
        for _ in range(2):
            code, error = cells.assign(v)
            assert code.tolist() == want[0].tolist() and error.tolist() == want[1].tolist()
        assert cells.pairs < 0.5 * 64 * cells.rows and len(cells.memory) <= most
        assert cells.hits >= (cells.asked // 2 if most > 10 else 10)


def test_few_rows_odd_lengths_and_empty_tables(spark):
    rows = [(i, [float(i), 0.5, -0.25, 2.0, 1.0, -1.0], i % 2) for i in range(5)]     # no multiple of four; fewer rows than entries
    same(vector_codes.compress(table(spark, [*rows, (9, [1.0] * 8, 0)])).collect(), codes_by_hand(rows, 4, 256, 4))
    assert vector_codes.compress(table(spark, BAD[:5])).collect() == []
    assert vector_codes.compress(table(spark, BAD).limit(0)).collect() == []
    wide = [(i, [float(i), -float(i)], 0) for i in range(6)]                             # more parts than components
    same(vector_codes.compress(table(spark, wide), codes=3).collect(), codes_by_hand(wide, 4, 3, 4))


def test_many_labels_are_joined_by_salted_keys(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    same(vector_codes.compress(table(spark, rows), codes=16, rounds=1).collect(), codes_by_hand(rows, 4, 16, 1))


# ---------------------------------------------------------------- clusters

def clusters_by_hand(rows, k, rounds, seed, scale):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    entries, found = lloyd([exact(r[1], scale) for r in rows], [i for i in order if rows[i][0] is not None][:k] or order[:k], rounds)
    found = [(n, long(d)) for n, d in found]
    sums = {n: [d for m, d in found if m == n] for n in range(len(entries))}
    sums = {n: long(sum(d)) if None not in d else None for n, d in sums.items()}
    used = [sums[n] for n in {n for n, _ in found}]
    total = long(sum(used)) if None not in used else None
    return [(r[0], n, d, sums[n], total, hashlib.sha256(",".join(map(str, entries[n])).encode()).hexdigest()) for r, (n, d) in zip(rows, found, strict=True)]


@pytest.mark.parametrize("huge", [False, True])
@pytest.mark.parametrize("block", [7, 512])
def test_clusters_equal_brute_force(spark, huge, block):
    rows = vectors(huge=huge)
    got = centroid_clusters.cluster(table(spark, rows + BAD), k=6, rounds=3, seed=4, dims=8, scale=64, block_rows=block)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same(got.collect(), clusters_by_hand(rows, 6, 3, 4, 64))


def test_fewer_vectors_than_centroids_and_empty_tables(spark):
    rows = [(i, [float(i)] * 8, 0) for i in range(3)]
    same(centroid_clusters.cluster(table(spark, rows), dims=8).collect(), clusters_by_hand(rows, 16, 3, 1, 64))
    assert centroid_clusters.cluster(table(spark, BAD), dims=8).collect() == []
    assert centroid_clusters.cluster(table(spark, rows).limit(0)).collect() == []


def test_hilbert_order_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2 ** bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = centroid_clusters.hilbert_keys(grid, bits)
        assert len(set(keys)) == len(grid)
        walk = grid[sorted(range(len(grid)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_every_nearest_entry():
    rng = np.random.default_rng(5)
    exact = rng.integers(-300, 300, (40, 3)).astype(object)
    exact[7] = [10 ** 200, 0, 0]
    entries = integers.Entries(exact)
    dropped = 0
    for _ in range(200):
        low = rng.integers(-300, 300, 3).astype(float)
        high = low + rng.integers(0, 120, 3)
        keep = integers.survivors(low[None], high[None], entries)[0]
        points = rng.integers(low, high + 1, (50, 3)).astype(float)
        d = integers.distances(points, entries, np.arange(40))
        nearest = d == d.min(axis=1)[:, None]
        assert keep[nearest.any(axis=0)].all() and not keep[7]
        dropped += 40 - keep.sum()
    assert dropped > 200 * 10


def test_blocks_of_clustered_vectors_compare_few_centroids(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (8, 8))
    x = centres[rng.integers(0, 8, 4000)] + rng.normal(0, 0.02, (4000, 8))
    df = table(spark, [(i, row.tolist(), 0) for i, row in enumerate(x)])
    blocks = centroid_clusters.zone_map(df.selectExpr("vec_id as id", "embedding as raw"), 8, 64, 64).collect()
    assigner = centroid_clusters.Assigner(np.floor(centres * 64).astype(np.int64).astype(object), 64)
    import pyarrow as pa
    for b in blocks:
        list(assigner.assign(pa.array(b["raw"]), b["low"], b["high"]))
    assert assigner.compared < 3 * assigner.blocks
