"""Toxicity by nearest labelled examples under TF-IDF cosine, over a block-max inverted index.

*Fitting.*  Of the labelled rows whose text has at most ``most_chars`` characters, at most ``most_toxic`` and ``most_clean``
(the first by a hash of the id) are examples: rows and bytes are bounded, and no text is cut.  Terms are all words of the
examples, and word beginnings of 4 to 6 letters that toxic examples hold more often than clean ones.  A term weighs its
IDF times ``least_weight`` to the power of what its likelihood ratio lacks of ``least_ratio``: terms that tell toxic from
clean count in full, all others a little, so texts without any telling term are compared on all their words.  (This
departs from plain TF-IDF, ``least_weight=1``, which finds few toxic texts; the README has the figures of both.)

*Index.*  Terms are known by the 64-bit hash of their letters; everything shared is a flat array of bounded size.  Examples
are dealt to blocks of ``block``, alike ones together (by their heaviest common term).  The postings of rare terms are short
and added up outright.  For common terms the index keeps each block's greatest weight: the bound of a block is the best of its
examples' sums so far plus what its maxima allow, and only blocks whose bound reaches the kth best sum are scored.  The k
nearest are exact, ties to the smaller id.

*Score.*  The neighbours vote with weight cosine^2 / (1.02 - cosine^2), so a copy of an example outvotes what is merely like
it (and the weight of their class, as examples are drawn by class), smoothed towards the share of toxic rows; votes are
calibrated by a monotone fit over leave-one-out votes of the examples, which Spark tasks compute.  The neighbours are the
evidence.

A null or empty text has no terms and gets the smoothing share; labels that are null are not used; an example labelled
twice counts as toxic if any label says so; ids may be of any ordered type; of rows that share a labelled id one text (the
smallest) is the example; repeated rows get equal scores; without examples every score is 0; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.llm.common import pick, released, written

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


def codes_of(terms: list[str]) -> np.ndarray:
    return hash_array(np.array(terms, dtype=object), categorize=False) if terms else np.empty(0, np.uint64)


class Terms:
    """Counts a text's words and word beginnings (marked with ``^``) by the hashes of both.

    ``known`` (ascending hashes) restricts and numbers terms; of beginnings only those in ``beginnings`` are looked at.
    """

    def __init__(self, known: np.ndarray | None = None, beginnings: frozenset[str] | None = None):
        self.known, self.beginnings = known, beginnings
        self.heads = None if beginnings is None else frozenset(b[:BEGINNINGS[0]] for b in beginnings)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes or numbers, counts), ascending."""
        counts = Counter(_WORD.findall((text or "").lower()))
        heads: Counter = Counter()
        if self.beginnings is None:
            for word, n in counts.items():
                for m in BEGINNINGS:
                    if len(word) >= m:
                        heads[f"^{word[:m]}"] += n
        else:
            for word, n in [x for x in counts.items() if x[0][:BEGINNINGS[0]] in self.heads]:
                for m in BEGINNINGS:
                    if len(word) >= m and word[:m] in self.beginnings:
                        heads[f"^{word[:m]}"] += n
        counts.update(heads)
        codes = codes_of(list(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        if self.known is not None:
            if not len(self.known):
                return np.empty(0, np.int64), np.empty(0, np.int64)
            at = np.searchsorted(self.known, codes)
            there = self.known[np.minimum(at, len(self.known) - 1)] == codes
            codes, n = at[there], n[there]
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        if len(codes) and (codes[1:] == codes[:-1]).any():   # two terms of one hash are one term
            codes, first = np.unique(codes, return_index=True)
            n = np.add.reduceat(n, first)
        return codes, n


class Index:
    """Examples as unit vectors of weighted terms in a block-max index, with labels, class weights and calibration.

    ``weight`` has the terms' weights; ``size``, ``term`` and ``n`` say how many terms each example has, which, and how often.
    Examples come in the order of their ids.
    """

    def __init__(self, known: np.ndarray, beginnings: frozenset[str], weight: np.ndarray, ids: list, labels, vectors: tuple,
                 class_weight: tuple[float, float], k: int = 15, block: int = 32, smooth: float = 0.2):
        size, term, n = (np.asarray(x, np.int64) for x in vectors)
        self.terms, self.weight, self.k, self.block, self.smooth = Terms(known, beginnings), np.asarray(weight, float), k, block, smooth
        labels, class_weight = np.asarray(labels, np.int64), np.asarray(class_weight, float)
        full = size > 0
        none = labels[~full]
        total, toxic = class_weight[labels].sum(), (class_weight[labels] * labels).sum()
        # texts without terms: as the examples without terms are, smoothed towards the share of toxic rows
        self.share = float(((class_weight[none] * none).sum() + (toxic / total if total else 0)) / (class_weight[none].sum() + 1)) if len(labels) else 0.0
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.ids, self.labels, size = [i for i, f in zip(ids, full.tolist(), strict=True) if f], labels[full], size[full]
        self.votes_of = class_weight[self.labels]
        self.flat = (size.astype(np.int32), term.astype(np.int32), n.astype(np.min_scalar_type(int(n.max(initial=0)))))
        self._build()

    def __getstate__(self) -> dict:
        """What is shared: counts and labels; weights, blocks and maxima are computed again where it is read."""
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "start", "at", "w", "row", "matrix", "maxima", "blocks")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._build()

    def _build(self) -> None:
        size, term, n = self.flat
        m, terms = len(size), len(self.weight)
        df = np.bincount(term, minlength=terms)
        w = (1 + np.log(np.maximum(n, 1).astype(float))) * self.weight[term]
        of = np.repeat(np.arange(m), size)
        w /= np.sqrt(np.bincount(of, w * w, minlength=m))[of]
        common = df * 16 > max(m, 64)
        self.row = np.full(terms, -1, np.int32)   # of common terms, their row in the matrix
        self.row[common] = np.arange(common.sum())
        heavy = np.full(m, -1, np.int64)           # of each example its heaviest common term
        dense = np.nonzero(common[term])[0]
        order = dense[np.lexsort((w[dense], of[dense]))]
        heavy[of[order]] = term[order]
        self.place = np.argsort(heavy, kind="stable")   # place in the blocks -> example
        put = np.empty(m, np.int64)
        put[self.place] = np.arange(m)
        self.blocks = -(-m // self.block)
        self.matrix = np.zeros((int(common.sum()), self.blocks * self.block))
        self.matrix[self.row[term[dense]], put[of[dense]]] = w[dense]
        self.maxima = self.matrix.reshape(len(self.matrix), self.blocks, self.block).max(axis=2, initial=0.0)
        rare = np.nonzero(~common[term])[0]
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.at, self.w = put[of[rare]].astype(np.int32), w[rare]
        self.start = np.concatenate([[0], np.cumsum(np.where(common, 0, df))])

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights, as a unit vector."""
        terms, n = self.terms(text)
        return self.unit(terms, n)

    def unit(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weight[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, vectors: list, skip: list[int | None] | None = None) -> list[list[tuple[float, int]]]:
        """For each vector the k best (cosine, number of the example), best first, ties to the smaller id; ``skip`` leaves one out."""
        m, width = len(self.labels), self.blocks * self.block
        self.asked = self.scored = 0   # pairs of (text, block), for tests
        if not m:
            return [[] for _ in vectors]
        sums = np.zeros((len(vectors), width))
        q = np.zeros((len(vectors), len(self.matrix)))
        put = None
        for i, (terms, w) in enumerate(vectors):
            row = self.row[terms]
            q[i, row[row >= 0]] = w[row >= 0]
            terms, w = terms[row < 0], w[row < 0]
            first, length = self.start[terms], self.start[terms + 1] - self.start[terms]
            ends = np.cumsum(length)
            if len(ends) and ends[-1]:
                where = np.repeat(first - ends + length, length) + np.arange(ends[-1])
                sums[i] = np.bincount(self.at[where], self.w[where] * np.repeat(w, length), minlength=width)
            if skip is not None and skip[i] is not None:
                if put is None:
                    put = np.argsort(self.place)
                sums[i, put[skip[i]]] = -1e9
        bounds = sums.reshape(len(vectors), self.blocks, self.block).max(axis=2) + q @ self.maxima
        done = np.zeros(bounds.shape, bool)

        def score(wanted: np.ndarray) -> None:
            for b in np.nonzero(wanted.any(axis=0))[0].tolist():
                some, part = np.nonzero(wanted[:, b])[0], slice(b * self.block, (b + 1) * self.block)
                sums[some, part] += q[some] @ self.matrix[:, part]
            done[wanted] = True

        def least() -> np.ndarray:
            # sums so far never exceed the cosines, so the kth best of some of them is a threshold for the bounds
            tops = sums.reshape(len(sums), self.blocks, self.block).max(axis=2) if self.blocks > self.k else sums
            return np.partition(tops, tops.shape[1] - self.k, axis=1)[:, tops.shape[1] - self.k] if tops.shape[1] > self.k else np.zeros(len(sums))

        best = np.zeros(bounds.shape, bool)
        np.put_along_axis(best, np.argsort(-bounds, axis=1)[:, :2], True, axis=1)
        score(best)
        score((bounds >= least()[:, None] - 1e-9) & (bounds > 0) & ~done)
        self.asked, self.scored = done.size, int(done.sum())
        out = []
        for s, kth in zip(sums, least(), strict=True):
            found = np.nonzero((s > 1e-12) & (s >= kth - 1e-11))[0]
            cosine, number = np.round(s[found], 12), self.place[found]
            order = np.lexsort((number, -cosine))[:self.k]
            out.append(list(zip(cosine[order].tolist(), number[order].tolist(), strict=True)))
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        # the nearer an example is to the very text, the more its vote counts
        pull = [s * s / (1.02 - min(s, 1.0) ** 2) * self.votes_of[i] for s, i in near]
        yes = sum(p for p, (_, i) in zip(pull, near, strict=True) if self.labels[i])
        return (yes + self.smooth * self.share) / (sum(pull) + self.smooth)

    def scores(self, texts, at_once: int = 128):
        """(calibrated probability, nearest examples) of each text."""
        texts = iter(texts)
        while vectors := [self.vector(t) for t in islice(texts, at_once)]:
            for near in self.nearest(vectors):
                yield min(1.0, max(0.0, float(np.interp(self.vote(near), *self.knots)))), near


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares increasing fit (pool adjacent violators) as the knots of a broken line from 0 to 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []   # weight, mean of y, mean of x
    for i in order.tolist():
        pools.append([weight[i], y[i], x[i]])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            (w2, y2, x2), (w1, y1, x1) = pools.pop(), pools.pop()
            w = w1 + w2
            pools.append([w, (w1 * y1 + w2 * y2) / w, (w1 * x1 + w2 * x2) / w])
    kx, ky = np.array([p[2] for p in pools]), np.array([p[1] for p in pools])
    return kx, ky


def _examples(docs: DataFrame, labels: DataFrame, most: tuple[int, int], most_chars: int) -> tuple[DataFrame, tuple[int, int]]:
    """(id, text, y) of the examples, and how many labelled rows with such texts each class has."""
    spark = docs.sparkSession
    rows = labels.where("id is not null and y is not null").groupBy("id").agg(F.max("y").cast("int").alias("y"))
    lengths = docs.where(F.length("text") <= most_chars).select("id").distinct()
    rows = written(rows.join(lengths, "id"), "labels")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = [min(1.0, 4 * m / max(1, n.get(y, 0)) + 64 / max(1, n.get(y, 0))) for y, m in enumerate(most)]
    # by hash, so tasks send few rows to the final choice: about four times those chosen
    lot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    near = rows.where(lot < F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])) * (1 << 30))
    chosen = [near.where(F.col("y") == y).orderBy(lot, "id").limit(m) for y, m in enumerate(most)]
    # at most sum(most) pairs of an id and a label: small enough to broadcast
    chosen = spark.createDataFrame(chosen[0].unionByName(chosen[1]).collect(), rows.schema)
    texts = docs.where(F.length("text") <= most_chars).join(F.broadcast(chosen), "id")
    return written(texts.groupBy("id", "y").agg(F.min("text").alias("text")), "examples"), (n.get(0, 0), n.get(1, 0))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 2500, most_clean: int = 6500, most_chars: int = 20_000,
        least_ratio: float = 25.0, least_weight: float = 0.01) -> Index:
    """``docs``: id, text; ``labels``: id, y (0 or 1).  What is shared grows with ``most_toxic + most_clean`` texts of at most
    ``most_chars`` characters: at worst 60 MB of terms and counts for each 10 million words."""
    spark = docs.sparkSession
    examples, there = _examples(docs, labels, (most_clean, most_toxic), most_chars)
    sizes = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1:
        return Index(np.empty(0, np.uint64), frozenset(), [], [], [], ([], [], []), (1.0, 1.0))

    def appearing(batches):
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
                words = dict.fromkeys(_WORD.findall((text.as_py() or "").lower()))
                terms = [*words, *dict.fromkeys(f"^{w[:m]}" for w in words for m in BEGINNINGS if len(w) >= m)]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([y] * len(terms), pa.int32())], ["term", "y"])

    a, b = F.col("a"), F.col("b")
    found = (examples.select("y", "text").mapInArrow(released(appearing), "term string, y int")
             .groupBy("term").agg(F.sum("y").alias("a"), F.sum(F.lit(1) - F.col("y")).alias("b")))
    expected = (a + b) * (n1 / (n0 + n1))
    ratio = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0.0))
    # a term that half as many clean as toxic rows hold says little
    telling = (a > expected) & (b * n1 * 4 < a * max(n0, 1))
    found = found.withColumn("ratio", F.when(telling, F.least(ratio, F.lit(least_ratio))).otherwise(0.0))
    kept = found.where((F.col("ratio") > 0) | ~F.col("term").startswith("^")).toArrow()
    codes = codes_of(kept["term"].to_pylist())
    known, first = np.unique(codes, return_index=True)
    holding = (kept["a"].to_numpy() + kept["b"].to_numpy())[first]
    weight = (np.log((n0 + n1 + 1) / (holding + 1)) + 1) * least_weight ** (1 - kept["ratio"].to_numpy()[first] / least_ratio)
    beginnings = frozenset(t[1:] for t in kept.filter(pc.starts_with(kept["term"], "^"))["term"].to_pylist())
    del kept, codes
    kind = examples.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(Terms(known, beginnings))   # bounded by the examples

    def vectors(batches):
        for batch in batches:
            pairs = [shared.value(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *(pa.array([p[i].astype(np.int32) for p in pairs], pa.list_(pa.int32()))
                                                                                       for i in (0, 1))], ["id", "y", "t", "n"])

    rows = examples.select("id", "y", "text").mapInArrow(released(vectors), f"id {kind}, y int, t array<int>, n array<int>")
    table = rows.orderBy("id").toArrow()
    shared.destroy()
    weights = tuple(there[y] / sizes[y] if sizes.get(y) else 1.0 for y in (0, 1))
    flat = (pc.list_value_length(table["t"]).to_numpy(), pc.list_flatten(table["t"]).to_numpy(), pc.list_flatten(table["n"]).to_numpy())
    index = Index(known, beginnings, weight, table["id"].to_pylist(), table["y"].to_numpy(), flat, weights)
    del table, flat
    index.knots = _calibrated(examples, index, weights)
    return index


def _calibrated(examples: DataFrame, index: Index, class_weight: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Knots from raw vote to share of toxic rows, by the examples' votes without themselves."""
    shared = examples.sparkSession.sparkContext.broadcast(index)
    numbers = {x: i for i, x in enumerate(index.ids)}

    def run(batches):
        index = shared.value
        for batch in batches:
            ids, votes = batch.column("id").to_pylist(), []
            for at in range(0, len(ids), 64):
                found = index.nearest([index.vector(t.as_py()) for t in batch.column("text")[at:at + 64]], [numbers.get(x) for x in ids[at:at + 64]])
                votes += [index.vote(near) if x in numbers else index.share for x, near in zip(ids[at:at + 64], found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column("y")], ["vote", "y"])

    votes = examples.select("id", "y", "text").mapInArrow(released(run), "vote double, y int").toArrow().sort_by([("vote", "ascending"), ("y", "ascending")])
    shared.destroy()   # one row per example came back
    y = votes["y"].to_numpy()
    return monotone(votes["vote"].to_numpy(), y.astype(float), np.asarray(class_weight)[y])


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """``id_col``, score and evidence (the nearest examples: example, cosine, toxic) of every row."""
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
    from pyspark.sql.pandas.types import to_arrow_type

    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(index)   # bounded by the fit's parameters
    proof = ArrayType(StructType([StructField("example", kind), StructField("cosine", DoubleType()), StructField("toxic", IntegerType())]))
    arrow = to_arrow_type(proof)

    def run(batches):
        index = shared.value
        for batch in batches:
            scores, seen = [], []
            for p, near in index.scores(text.as_py() for text in batch.column("text")):
                scores.append(p)
                seen.append([{"example": index.ids[i], "cosine": s, "toxic": int(index.labels[i])} for s, i in near[:evidence]])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(seen, arrow)], ["id", "score", "evidence"])

    out = rows.mapInArrow(released(run), StructType([StructField("id", kind), StructField("score", DoubleType()), StructField("evidence", proof)]))
    return out.withColumnRenamed("id", id_col)


def keep(docs: DataFrame, index: Index, below: float, text_col: str = "text") -> DataFrame:
    """The rows whose own text scores less than ``below``, with their columns; ids play no part."""
    names = docs.columns
    at = names.index(text_col)
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        for batch in batches:
            fine = [p < below for p, _ in index.scores(text.as_py() for text in batch.column(at))]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return rows.mapInArrow(released(run), rows.schema).toDF(*names)
