"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP`` and cover the whole text.  Learned
filters of ``WIDTH`` bytes slide over each chunk by ``STRIDE``; their largest responses are the chunk's features (max
pooling).  The mean and the maximum of the features over all chunks go through a small hidden layer into one probability.

The network is fitted by Adam on the driver, on a bounded sample of labelled rows: at most ``most_per_class`` of each class
(the first by a hash of the id) whose texts have at most ``fit_bytes`` bytes, with all chunks of these texts; class weights restore
the shares of the labelled rows.  Scoring covers every byte of every text, and its memory does not grow with a text's length
beyond the text.

Null and empty texts are one chunk of padding and get a score like any other; labels that are null are not used; an id
labelled twice counts as good only if all its labels do; without labels of both classes, or without texts of both in the
sample, the score is the labelled rows' share of good ones (0.5 without any); repeated rows get equal scores; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.llm.common import pick, written

CHUNK, OVERLAP, WIDTH, STRIDE = 512, 64, 6, 2


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes; one for an empty text."""
    step = CHUNK - OVERLAP
    return np.arange(max(1, -(-(n - OVERLAP) // step))) * step


def chunks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The chunks as rows of bytes; the last is padded with zeros."""
    padded = np.zeros(int(starts[-1]) + CHUNK, np.uint8)
    padded[:len(raw)] = np.frombuffer(raw, np.uint8)[:len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[starts]


class Network:
    """``table[j, byte, f]``: response of filter f to a byte at its place j."""

    def __init__(self, filters: int = 32, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.w1 = rng.normal(0, (2 * filters) ** -0.5, (2 * filters, hidden)).astype(np.float32)
        self.b1 = np.zeros(hidden, np.float32)
        self.w2 = rng.normal(0, hidden ** -0.5, hidden).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.constant: float | None = None

    def responses(self, rows: np.ndarray) -> np.ndarray:
        places = (CHUNK - WIDTH) // STRIDE + 1
        out = None
        for j in range(WIDTH):
            part = self.table[j].take(rows[:, j:j + STRIDE * places:STRIDE], axis=0)
            out = part if out is None else np.add(out, part, out=out)
        return out

    def pooled(self, rows: np.ndarray, step: int = 16) -> np.ndarray:
        """Features of chunks, a few chunks at a time so that the responses stay in the cache."""
        best = [self.responses(rows[at:at + step]).max(axis=1) for at in range(0, len(rows), step)]
        return np.maximum(np.concatenate(best) + self.bias, 0)

    def combine(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probability per text from its chunks' features; ``first``: each text's first chunk."""
        n = np.diff([*first, len(features)])[:, None]
        doc = np.concatenate((np.add.reduceat(features, first) / n, np.maximum.reduceat(features, first)), axis=1)
        h = np.tanh(doc @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-(h @ self.w2 + self.b2))), h, doc

    def predict(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first), self.constant)
        return self.combine(self.pooled(rows), first)[0]

    # -------------------------------------------------------------- fitting

    def gradients(self, rows: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        filters = len(self.bias)
        best, at = [], []
        for a in range(0, len(rows), 16):
            r = self.responses(rows[a:a + 16])
            place = r.argmax(axis=1)
            at.append(place)
            best.append(np.take_along_axis(r, place[:, None, :], 1)[:, 0])
        best, at = np.concatenate(best) + self.bias, np.concatenate(at)
        features = np.maximum(best, 0)
        p, h, doc = self.combine(features, first)
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        g = {"w2": h.T @ d, "b2": d.sum(keepdims=True)}
        dh = d[:, None] * self.w2 * (1 - h * h)
        g |= {"w1": doc.T @ dh, "b1": dh.sum(axis=0)}
        ddoc = dh @ self.w1.T
        n = np.diff([*first, len(rows)])
        owner = np.repeat(np.arange(len(first)), n)
        df = ddoc[owner, :filters] / n[owner][:, None]
        most = doc[owner, filters:]
        df += np.where(features == most, ddoc[owner, filters:], 0)
        df = np.where(best > 0, df, 0)
        g["bias"] = df.sum(axis=0)
        flat = np.zeros(WIDTH * 256 * filters, np.float32)
        for j in range(WIDTH):
            byte = np.take_along_axis(rows, at * STRIDE + j, 1).astype(np.int64)
            flat += np.bincount(((j * 256 + byte) * filters + np.arange(filters)).ravel(), df.ravel(), len(flat)).astype(np.float32)
        g["table"] = flat.reshape(self.table.shape)
        return g

    def fit(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        names = ("table", "bias", "w1", "b1", "w2", "b2")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t, steps = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                part = order[a:a + batch]
                rows = np.concatenate([texts[i] for i in part])
                first = np.cumsum([0, *(len(texts[i]) for i in part[:-1])])
                t += 1
                for k, g in self.gradients(rows, first, y[part], weight[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    step = rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))
        return self


def fit(docs: DataFrame, labels: DataFrame, most_per_class: int = 2000, fit_bytes: int = 20_000) -> Network:
    """``docs``: id, text; ``labels``: id, y (0 or 1)."""
    spark = docs.sparkSession
    known = written(labels.where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y")), "labels")
    n = {int(r["y"]): r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    network = Network()
    if not n.get(0) or not n.get(1):
        network.constant = n.get(1, 0) / sum(n.values()) if n else 0.5
        return network
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most_per_class) for y in (0, 1)]
    chosen = spark.createDataFrame(chosen[0].unionByName(chosen[1]).collect(), known.schema)   # 2 * most_per_class pairs of numbers

    def cut(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                out.append(chunks(raw, chunk_starts(len(raw))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(out, pa.binary())], ["id", "y", "chunks"])

    rows = docs.join(F.broadcast(chosen), "id").select("id", F.col("y").cast("int").alias("y"), "text")
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= fit_bytes)
    rows = rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, y int, chunks binary").dropDuplicates(["id"]).orderBy("id").collect()
    y = np.array([r["y"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        network.constant = n[1] / sum(n.values())
        return network
    share = {c: n[c] / sum(n.values()) / max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([share[int(c)] for c in y], np.float32) * len(y)
    return network.fit([np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in rows], y, weight)


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", most_chunks: int = 4096) -> DataFrame:
    """``id_col`` and score (probability of label 1) of every row."""
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)   # of fixed size

    def features(network: Network, raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Sum and maximum of a text's chunk features, by slices of its chunks."""
        starts = chunk_starts(len(raw))
        total, most = 0, None
        for a in range(0, len(starts), most_chunks):
            part = starts[a:a + most_chunks]
            piece = raw[int(part[0]):int(part[-1]) + CHUNK]
            f = network.pooled(chunks(piece, part - part[0]))
            total, most = total + f.sum(axis=0), f.max(axis=0) if most is None else np.maximum(most, f.max(axis=0))
        return total, most, len(starts)

    def run(batches):
        network = shared.value
        for batch in batches:
            ids = batch.column("id")
            for at in range(0, batch.num_rows, 256):
                part, scores = batch.slice(at, 256), []
                for text in part.column("text"):
                    if network.constant is not None:
                        scores.append(network.constant)
                        continue
                    total, most, n = features(network, (text.as_py() or "").encode())
                    doc = np.concatenate((total / n, most))
                    scores.append(float(1 / (1 + np.exp(-(np.tanh(doc @ network.w1 + network.b1) @ network.w2 + network.b2[0])))))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(scores, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
