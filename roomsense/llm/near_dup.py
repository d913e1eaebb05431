"""MinHash near-duplicates with tensored banding.

A document's set is its distinct 5-word shingles (ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+``); with fewer words the
whole sequence is the one shingle; without words the set is empty and linked with nothing.  Two documents are linked if
100 * intersection >= percent * union.

*Tensored banding*: instead of one collection of L bands of 2r rows there are two collections of m half-bands of r rows;
a table's key combines half-band i of the first with half-band j of the second, so 2 * m * r minhashes serve m * m
tables.  A pair of similarity s meets in a table with probability (1 - (1 - s^r)^m)^2; m is the smallest number for which
a pair at the threshold is missed with probability ``miss`` or less.

The work, as Spark jobs:

1. one pass over the texts gives every document's set size, a 128-bit fingerprint of its set and its half-bands;
2. documents of equal sets are one class, represented by its smallest id (an aggregate, combined before its shuffle);
3. half-bands that no other class has are dropped before the keys are formed, so unlike documents never reach a table;
   buckets of equal members count once;
4. in each bucket the members are compared with a leader (the one that shares most half-bands) on their full sets, which
   joins a group of copies by a star instead of by all its pairs;
5. where a bucket's members are not yet in one component, blocks of ``BLOCK`` members are compared at once as a product of
   0/1 matrices over their shingles; members of one team (neighbouring components) are compared once, not in each bucket.
   Only what joins two components leaves a block, so the rows stay in proportion to the members.  Sets of more than
   ``FULL`` shingles enter as samples by hash.  Of the partners that samples do not rule out, a member names its likeliest
   one; these pairs are compared on their full sets, and members that are joined drop out.
   Members still apart name their next two partners, then the next four, until none is left, so linked members are joined
   by a few turns and a pair is left out only between members already joined;
6. components of the links by alternating stars.

Null ids take part in nothing and are kept; null and empty texts have n_shingles 0 and are their own component.  Ids are
taken to be unique; repeated rows (same id and text) get equal results.  An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.llm.common import pick, released, written
from roomsense.llm.components import components

U64 = np.uint64
#: Members of a bucket that are compared with each other, or with as many others, in one group.
BLOCK = 512
#: Sets up to this size enter a block whole.
FULL = 1024
#: Probability that a pair at the threshold agrees in fewer minhashes than asked for.
SURE = 1e-8


# ------------------------------------------------------------------ sets

class _Hashes(dict):
    """Word -> 64-bit hash, remembering a bounded number of words for the length of a task."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def shingles(text: str | None, words: int = 5, hashes: _Hashes | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles.  ``bytes.lower`` and ``bytes.split`` are exactly ASCII's."""
    hashes = _Hashes() if hashes is None else hashes
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, U64)
    h = np.fromiter(map(hashes.__getitem__, parts), U64, len(parts))
    n, width = max(1, len(h) - words + 1), min(words, len(h))
    out = np.full(n, width, U64)
    for i in range(width):   # order counts: every step mixes in the next word
        out = (out * U64(0x9E3779B97F4A7C15) + h[i:i + n]) ^ (out >> U64(29))
    return np.unique(_mix(out))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted arrays of distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


# ------------------------------------------------------------------ minhash

def half_bands(percent: int, rows: int = 4, miss: float = 1e-4) -> int:
    """Smallest m with 1 - (1 - (1 - s^rows)^m)^2 <= miss at s = percent / 100."""
    none = 1 - math.sqrt(1 - miss)
    s = (percent / 100) ** rows
    return 1 if s >= 1 else max(1, math.ceil(math.log(none) / math.log(1 - s)))


def least_agreement(percent: int, n: int, sure: float = SURE) -> int:
    """Largest c for which a pair at the threshold agrees in fewer than c of n minhashes with probability ``sure`` at most."""
    s, below = percent / 100, 0.0
    for c in range(n + 1):
        below += math.comb(n, c) * s ** c * (1 - s) ** (n - c)
        if below > sure:
            return c
    return n


class MinHash:
    """2 * m half-bands of ``rows`` minhashes, as 64-bit keys."""

    def __init__(self, m: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = 2 * m * rows
        self.m, self.rows = m, rows
        self.flip = rng.integers(0, 2 ** 32, n, dtype=np.uint32)[:, None]
        self.times = (rng.integers(0, 2 ** 32, n, dtype=np.uint32) | np.uint32(1))[:, None]
        self.salt = rng.integers(0, 2 ** 63, 2 * m, dtype=np.int64).astype(U64)

    def bands(self, hashes: np.ndarray, step: int = 2048) -> tuple[np.ndarray, bytes]:
        """The keys of all half-bands, those of the first collection first; a byte of every minhash."""
        h = (hashes >> U64(32)).astype(np.uint32)
        least = np.full(len(self.flip), np.uint32(0xFFFFFFFF))
        for at in range(0, len(h), step):
            np.minimum(least, ((h[at:at + step] ^ self.flip) * self.times).min(axis=1), out=least)
        key = self.salt.copy()
        for column in least.reshape(2 * self.m, self.rows).T:
            key = _mix(key * U64(31) + column)
        return key.view(np.int64), (least >> np.uint32(3)).astype(np.uint8).tobytes()


def _signatures(m: int, rows: int, words: int, id_type: pa.DataType):
    def run(batches):
        minhash, hashes = MinHash(m, rows), _Hashes()
        bands = pa.list_(pa.int64())
        for batch in batches:
            ids = batch.column("id")
            for at in range(0, batch.num_rows, 1024):
                n, k1, k2, keys, sketch = [], [], [], [], []
                for text in batch.column("text").slice(at, 1024):
                    s = shingles(text.as_py(), words, hashes)
                    n.append(len(s))
                    if len(s):
                        k1.append(int(s.sum().astype(np.int64)))
                        k2.append(int(_mix(s ^ U64(0x5851F42D4C957F2D)).sum().astype(np.int64)))
                        bands_, sketch_ = minhash.bands(s)
                        keys.append(bands_)
                        sketch.append(sketch_)
                    else:
                        k1.append(0)
                        k2.append(0)
                        keys.append(None)
                        sketch.append(None)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1024), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                                  pa.array(keys, bands), pa.array(sketch, pa.binary())], ["id", "n_shingles", "k1", "k2", "bands", "sketch"])
    return run


# ------------------------------------------------------------------ verification

def _verify(percent: int, words: int):
    def run(batches):
        sets: OrderedDict[str, np.ndarray] = OrderedDict()   # a leader's set serves the rows after it
        hashes = _Hashes()

        def leader(text):
            if text not in sets:
                sets[text] = shingles(text, words, hashes)
                if len(sets) > 32:
                    sets.popitem(last=False)
            return sets[text]

        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            yes = [similar(leader(b.as_py()), shingles(a.as_py(), words, hashes), percent) for a, b in zip(batch.column("x_text"), batch.column("y_text"), strict=True)]
            keep = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(keep), y.filter(keep)], ["x", "y"])
    return run


def _promising(percent: int, least: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("x_n", "y_n"))
            fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            if batch.num_rows:
                xs, ys = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x_sketch", "y_sketch"))
                fits &= (xs == ys).sum(axis=1) >= least
            keep = pa.array(fits, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("x", "y")], ["x", "y"])
    return run


def promising(pairs: DataFrame, sketches: DataFrame, percent: int, minhashes: int) -> DataFrame:
    """The pairs that set sizes and minhashes do not rule out."""
    x, y = (sketches.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")) for c in "xy")
    kind = sketches.schema["rep"].dataType.simpleString()
    return pairs.join(x, "x").join(y, "y").mapInArrow(released(_promising(percent, least_agreement(percent, minhashes))), f"x {kind}, y {kind}")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """The pairs (x, y) whose full sets are linked.  ``y`` may be a hot key: its partition of the join can be split."""
    x = texts.select(F.col("id").alias("x"), F.col("text").alias("x_text"))
    y = texts.select(F.col("id").alias("y"), F.col("text").alias("y_text"))
    kind = texts.schema["id"].dataType.simpleString()
    return pairs.join(x, "x").join(y, "y").mapInArrow(released(_verify(percent, words)), f"x {kind}, y {kind}")


def _buckets(classes: DataFrame, m: int) -> DataFrame:
    """Buckets of two or more classes: key, rep, lead (the member that shares most half-bands).  Buckets of equal members are given once."""
    half = classes.select("rep", F.posexplode("bands").alias("at", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    half = written(half.join(shared, "half").select("rep", (F.col("at") < m).alias("first"), "half", "n"), "half-bands")
    score = half.groupBy("rep").agg(F.sum("n").alias("score"))
    a = half.where("first").select("rep", F.col("half").alias("a"))
    b = half.where("not first").select("rep", F.col("half").alias("b")).join(score, "rep")
    full = written(a.join(b, "rep").select(F.xxhash64("a", "b").alias("key"), "rep", "score"), "keys")
    who = F.xxhash64("rep").cast("decimal(38,0)")
    groups = full.groupBy("key").agg(F.count("*").alias("n"), F.sum(who).alias("f1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("f2"),
                                     F.max(F.struct("score", "rep"))["rep"].alias("lead")).where("n > 1")
    once = groups.groupBy("n", "f1", "f2").agg(F.min("key").alias("key"), F.min("lead").alias("lead")).select("key", "lead")   # equal members, equal leader
    return written(full.join(once, "key").select("key", "rep", "lead"), "buckets")


def _teams(stars: DataFrame, marks: DataFrame) -> DataFrame:
    """(node, component) of all members -> node, component, team: that of the component's neighbour of most members, or its own.

    Components are neighbours where a star has an end in each.  A large group of near copies and the members that no link joins
    to it make one team, so what buckets hold of them alone can be compared at once.
    """
    sizes = written(marks.groupBy("component").agg(F.count("*").alias("size")), "component-sizes")
    x, y = (marks.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "xy")
    ends = written(stars.join(x, "x").join(y, "y").where("cx <> cy").select("cx", "cy").distinct(), "neighbours")
    ends = ends.unionByName(ends.select(F.col("cy").alias("cx"), F.col("cx").alias("cy")))
    ends = ends.join(sizes, F.col("cy") == F.col("component")).select("cx", "cy", "size")
    ends = ends.unionByName(sizes.select(F.col("component").alias("cx"), F.col("component").alias("cy"), "size"))
    chosen = ends.groupBy("cx").agg(F.max(F.struct("size", "cy"))["cy"].alias("team"))
    return marks.join(chosen, F.col("component") == F.col("cx")).select("node", "component", "team")


def _open(buckets: DataFrame, teams: DataFrame) -> DataFrame:
    """What is still to be compared, as key, rep, component, blocks: buckets whose members are of several components.

    A bucket within one team is left to its team, all of whose members are then compared once instead of in each of its buckets,
    if that takes fewer rows than those buckets do.
    """
    rest = written(buckets.select("key", "rep").join(teams, F.col("rep") == F.col("node")).drop("node"), "bucket-components")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    apart = rest.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("team").alias("t1"), F.max("team").alias("t2"),
                                    F.count("*").alias("n")).where("c1 <> c2 and n > 2")   # of two members one was the leader
    apart = written(apart.select("key", "t1", "t2", "n", blocks.alias("blocks")), "open-keys")
    saved = apart.where("t1 = t2").groupBy(F.col("t1").alias("of")).agg(F.sum(F.col("n") * F.col("blocks")).alias("saved"))
    whole = teams.groupBy("team").agg(F.count("*").alias("n")).join(saved, F.col("team") == F.col("of"))
    whole = written(whole.where(F.col("n") * blocks <= F.col("saved")).select("of", blocks.alias("blocks")), "whole-teams")
    single = apart.join(whole.select("of"), (F.col("t1") == F.col("of")) & (F.col("t1") == F.col("t2")), "left_anti")
    rows = rest.join(single.select("key", "blocks"), "key").select("key", "rep", "component", "blocks")
    at_once = teams.join(whole, F.col("team") == F.col("of")).select(F.xxhash64("team", F.lit("team")).alias("key"), F.col("node").alias("rep"), "component", "blocks")
    return written(rows.unionByName(at_once), "open-buckets")


def _sampled(words: int):
    """(id, text) -> rep, level, hashes: those of the set's hashes whose ``level`` low bits are 0, ``FULL`` at most."""
    def run(batches):
        known = _Hashes()
        for batch in batches:
            level, hashes = [], []
            for text in batch.column("text"):
                s, n = shingles(text.as_py(), words, known), 0
                while len(s) > FULL:
                    n += 1
                    s = s[(s & U64((1 << n) - 1)) == 0]
                level.append(n)
                hashes.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(level, pa.int32()), pa.array(hashes, pa.binary())], ["rep", "level", "hashes"])
    return run


def _common(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as a product of 0/1 matrices, ``step`` shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (at, at + step))
        x = np.zeros((len(sets), min(step, int(shared.sum()) - at)), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        total += x @ x.T
    return total


def _joined(links: np.ndarray, component: np.ndarray) -> np.ndarray:
    """For each row the first row that it is connected with by links and equal components."""
    _, label = np.unique(component, return_inverse=True)
    first = np.full(label.max() + 1, len(component), np.int32)
    np.minimum.at(first, label, np.arange(len(component), dtype=np.int32))
    root = first[label]
    while True:
        least = np.where(links, root[None, :], np.int32(len(root))).min(axis=1)
        np.minimum.at(first, label, np.minimum(root, least))
        new = np.minimum(first[label], root)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _across(percent: int, turn: int):
    """Rows sorted by group (key, p, q) -> (x, y, sure, key) that join two components, or may.

    In a group with p < q, only rows of block p are compared with rows of block q.  Where sets are samples, a row names in
    turn t its partners from place 2^t - 1 on, 2^t of them at most, likeliest first, if they are not joined yet; the places do
    not depend on the turn.  A row without x says that its key has partners left for later turns.
    """
    def compare(rows: pa.Table) -> list[tuple]:
        ids, component = rows.column("rep").to_pylist(), np.unique(rows.column("component").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        block, level = rows.column("block").to_numpy(), int(rows.column("level").to_numpy().max())
        sets = [np.frombuffer(h, U64) for h in rows.column("hashes").to_pylist()]
        if level:
            sets = [x[(x & U64((1 << level) - 1)) == 0] for x in sets]
        common, sizes = _common(sets), np.array([len(x) for x in sets], np.float32)   # all exact: far below 2^24 / 100
        union = sizes[:, None] + sizes[None, :] - common
        asked = component[:, None] != component[None, :]
        if rows.column("p")[0].as_py() != rows.column("q")[0].as_py():
            asked &= block[:, None] != block[None, :]
        if level == 0:
            root = _joined(asked & (100 * common >= percent * union), component)
            # rows of one component are joined already and have one root: a row for each component says it all
            return [(ids[i], ids[root[i]], True, None) for i in np.unique(component, return_index=True)[1].tolist() if component[i] != component[root[i]]]
        t, n = percent / 100, rows.column("n_shingles").to_numpy()
        may = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        may &= common >= t * union - 6 * np.sqrt(t * (1 - t) * np.maximum(union, 1)) - 1
        if rows.column("p")[0].as_py() != rows.column("q")[0].as_py():
            may &= block[:, None] != block[None, :]
        np.fill_diagonal(may, False)
        now, more = np.zeros_like(may), False
        for i in np.nonzero((may & asked).any(axis=1))[0].tolist():   # a row's partners, likeliest first
            partners = np.nonzero(may[i])[0]
            partners = partners[np.argsort(-common[i, partners] / np.maximum(union[i, partners], 1), kind="stable")][2 ** turn - 1:]
            more |= bool(asked[i, partners[2 ** turn:]].any())
            now[i, partners[: 2 ** turn]] = asked[i, partners[: 2 ** turn]]
        key = rows.column("key")[0].as_py()
        out = [(ids[i], ids[j], False, key) for i, j in zip(*np.nonzero(np.triu(now | now.T)), strict=True)]
        return out + [(None, None, False, key)] * bool(more)

    def run(batches):
        def edges(table):
            marks = np.stack([table.column(c).to_numpy() for c in ("key", "p", "q")])
            return np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1

        def finish(table):
            at = [0, *edges(table), table.num_rows]
            found = [x for a, b in zip(at, at[1:], strict=False) if b - a > 1 for x in compare(table.slice(a, b - a))]
            kind = table.schema.field("rep").type
            cols = list(zip(*found, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, kind, pa.bool_(), pa.int64()), strict=True)], ["x", "y", "sure", "key"])

        held = None   # rows of the last group, which may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            last = [0, *edges(table)][-1]
            if last:
                yield finish(table.slice(0, last).combine_chunks())
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield finish(held.combine_chunks())
    return run


def _links(classes: DataFrame, texts: DataFrame, percent: int, words: int, m: int, rows: int) -> DataFrame:
    """Components (node, component) of the linked class representatives."""
    buckets = _buckets(classes, m)
    reps = buckets.select(F.col("rep").alias("id")).distinct()
    sketches = written(classes.join(reps, F.col("rep") == F.col("id"), "left_semi").select("rep", "n_shingles", "sketch"), "sketches")
    # the one shuffle of all texts, asked for by name so that every input size is planned alike
    members = written(texts.join(reps.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "member-texts")

    stars = written(buckets.where("rep <> lead").select(F.col("rep").alias("x"), F.col("lead").alias("y")).distinct(), "stars")
    links = written(verified(promising(stars, sketches, percent, 2 * m * rows), members, percent, words), "star-links")
    marks = written(reps.join(components(links), F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component")), "marks")
    live = _open(buckets, written(_teams(stars, marks), "teams"))
    kind = texts.schema["id"].dataType.simpleString()
    sets = members.join(live.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "text")
    sets = sets.mapInArrow(released(_sampled(words)), f"rep {kind}, level int, hashes binary").join(sketches.select("rep", "n_shingles"), "rep")
    sets = written(sets, "sets")
    for turn in range(64):
        rows_ = live.join(sets, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        rows_ = rows_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows_ = rows_.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "rep", "component", "n_shingles", "level", "hashes")
        rows_ = rows_.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
        joins = written(rows_.mapInArrow(released(_across(percent, turn)), f"x {kind}, y {kind}, sure boolean, key long"), "block-links")
        links = links.unionByName(joins.where("sure").select("x", "y"))
        unsure = joins.where("not sure and x is not null").select("x", "y")
        if not unsure.isEmpty():
            links = written(links.unionByName(verified(unsure.distinct(), members, percent, words)), "links")
        left = joins.where("x is null").select("key").distinct()
        if left.isEmpty():
            break
        # the buckets with partners left, under the components as they are now
        now = components(links)
        live = live.join(left, "key", "left_semi").drop("component").join(now, F.col("rep") == F.col("node"), "left")
        live = written(live.select("key", "rep", "blocks", F.coalesce("component", "rep").alias("component")), "open-buckets")
        apart = live.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
        live = live.join(apart, "key", "left_semi")
    return components(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = 5, rows: int = 4,
                    miss: float = 1e-4) -> DataFrame:
    """``id_col``, n_shingles, component_id (smallest id reachable over links) and kept (id = component_id) of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType
    m = half_bands(percent, rows, miss)
    sets = written(source.mapInArrow(released(_signatures(m, rows, words, to_arrow_type(kind))),
                                     f"id {kind.simpleString()}, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"), "shingle-sets")
    usable = sets.where("n_shingles > 0 and id is not null")
    # equal sets have equal half-bands, so any member's serve
    classes = written(usable.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.first("bands").alias("bands"),
                                                                         F.first("sketch").alias("sketch")), "classes")
    found = _links(classes.select("rep", "n_shingles", "bands", "sketch"), source.where("id is not null"), percent, words, m, rows)
    where = classes.select("k1", "k2", "n_shingles", "rep", "members")
    where = where.join(found, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "rep"))
    where = where.where("members > 1 or component_id <> rep").select("k1", "k2", "n_shingles", "component_id")
    out = sets.drop("bands", "sketch").join(where, ["k1", "k2", "n_shingles"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
