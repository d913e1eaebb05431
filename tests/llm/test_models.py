import random

import numpy as np
import pytest

from roomsense.llm import quality_cnn, topk_kdtree, toxicity
from roomsense.llm.common import pick
from tests.llm.helpers import ODD, documents


# ---------------------------------------------------------------- top-k

def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 0.1, (700, 6)), 2)
    x[100:160] = x[0]   # equal vectors, so ties
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    bad = [(9001, None, 1), (9002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (9003, [float("nan")] * 6, 1), (9050, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (9100, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + rows[:5] + bad, "vec_id long, embedding array<double>, VEC_ID2 int")
    for shard, block in ((64, 8), (8192, 4096)):
        got = topk_kdtree.top_k(df, lambda i: i % 50 == 0, k=5, shard_rows=shard, block_rows=block).toPandas()
        want = topk_kdtree.brute_force(list(range(700)), x, lambda n: n % 50 == 0, 5)
        assert got.sort_values(["query_id", "rank"]).values.tolist() == want.values.tolist()
    assert topk_kdtree.top_k(df.limit(0), lambda i: i % 50 == 0).collect() == []


def test_top_k_of_large_vectors_is_exact(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 5))
    x[7, 2], x[50, 0], x[51, 0], x[100] = 2.0 ** 40, 1.1e7, 1.1e7 + 1 / 256, [2.0 ** 5] * 5   # scores beyond 2^60 beside small ones
    x[100, 0] += 1 / 256
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    q = [[int(np.floor(v * 256)) for v in row] for row in x.tolist()]
    want = []
    for i in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in range(300) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for shard in (32, 8192):
        got = topk_kdtree.top_k(df, lambda i: i % 50 == 0, k=5, shard_rows=shard).collect()
        assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("kind, most", [("signs", 1 / 3), ("axes", 0.9)])
def test_queries_meet_only_shards_that_their_kth_score_reaches(spark, monkeypatch, kind, most):
    """Medians tell clusters round corners of a cube apart; clusters on the axes they cut in the middle, so most shards stay."""
    rng = np.random.default_rng(8)
    centres = np.eye(8) * 10 if kind == "axes" else rng.choice([-10.0, 10.0], (8, 8))
    x = np.round(centres[rng.integers(0, 8, 1600)] + rng.normal(0, 0.2, (1600, 8)), 2)
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    sizes = {}
    write = topk_kdtree.written

    def spy(rows, name, **options):
        back = write(rows, name, **options)
        sizes[name] = back.count() if name != "parts" else back.agg({"parts": "sum"}).first()[0]
        return back

    monkeypatch.setattr(topk_kdtree, "written", spy)
    got = topk_kdtree.top_k(df, lambda i: i % 20 == 0, k=5, shard_rows=50).toPandas()
    assert got.sort_values(["query_id", "rank"]).values.tolist() == topk_kdtree.brute_force(list(range(1600)), x, lambda n: n % 20 == 0, 5).values.tolist()
    print(kind, sizes)
    assert sizes["homes"] == 80 and sizes["asked-shards"] < most * 80 * (sizes["parts"] - 1)


def test_cells_hold_every_row_once():
    rng = np.random.default_rng(9)
    v = rng.integers(-50, 50, (1000, 3))
    tree = topk_kdtree.split_cells(v[:200], 8)
    n = np.bincount(topk_kdtree.cell_of(v, tree), minlength=8)
    assert n.sum() == 1000 and n.max() < 300
    assert topk_kdtree.cell_of(v, topk_kdtree.split_cells(v, 1)).tolist() == [0] * 1000


def test_few_candidates_give_all(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = topk_kdtree.top_k(df, lambda i: i % 50 == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 131072), (2, 2, -65536)]


# ---------------------------------------------------------------- toxicity

def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "ke") for b in ("lan", "der", "vis", "pol") for c in ("o", "a", "en", "ish")]
    texts, toxic = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 4) if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(["scoundr", "villai"]) + rng.choice(["el", "ny", "nous", "els", "x", "qu", "zz"])
        texts.append(" ".join(t).capitalize() + ".")
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_held_out_and_odd_rows(spark):
    texts, toxic = corpus()
    docs = documents(spark, texts + ODD)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic) if i % 3] + [(1, None), (None, 1)], "id long, y int")
    index = toxicity.fit(pick(docs, id="doc_id", text="text"), labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
    held = [i for i in range(len(texts)) if i % 3 == 0]
    right = [(got[i]["score"] >= 0.7) == bool(toxic[i]) for i in held]
    assert sum(right) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[len(texts) + i]["score"] < 0.5 and not got[len(texts) + i]["evidence"] for i in range(len(ODD)))
    assert any(got[i]["evidence"][0]["toxic"] for i in held if toxic[i])
    assert toxicity.score(docs.limit(0), index).collect() == []


def flat(vectors):
    return [len(v) for v in vectors], [t for v in vectors for t in sorted(v)], [v[t] for v in vectors for t in sorted(v)]


@pytest.mark.parametrize("block", [8, 64])
def test_block_max_search_is_exact_and_skips_blocks(block):
    rng = random.Random(7)
    n, terms, tongues = 600, 90, 3
    # each example has common terms of its own tongue and some rare ones
    vectors = [{t: rng.randint(1, 4) for t in [*rng.sample(range(10 * (i % tongues), 10 * (i % tongues) + 10), 4), *rng.sample(range(30, terms), rng.randint(0, 3))]}
               for i in range(n)]
    vectors[5] = vectors[2] = vectors[8]   # ties
    index = toxicity.Index(np.arange(terms, dtype=np.uint64), frozenset(), np.concatenate([np.full(30, 0.5), np.linspace(1, 3, terms - 30)]),
                           [f"e{i:04d}" for i in range(n)], [i % 2 for i in range(n)], flat(vectors), (1.0, 1.0), k=7, block=block)
    assert len(index.matrix) >= 20 and len(index.w)   # both common and rare terms

    def unit(v):
        found = index.unit(np.array(sorted(v)), np.array([v[t] for t in sorted(v)]))
        return dict(zip(found[0].tolist(), found[1].tolist(), strict=True))

    queries = [vectors[i] for i in (2, 40, 41)] + [{t: rng.randint(1, 3) for t in [*rng.sample(range(10), 2), *rng.sample(range(30, terms), 2)]} for _ in range(40)]
    units = [unit(v) for v in vectors]
    skip = [2, None, 41] + [None] * 40
    asked = [index.unit(np.array(sorted(q)), np.array([q[t] for t in sorted(q)])) for q in queries]
    for q, without, near in zip(queries, skip, index.nearest(asked, skip), strict=True):
        u = unit(q)
        scores = [(round(sum(u.get(t, 0) * w for t, w in v.items()), 9), -i) for i, v in enumerate(units) if i != without]
        want = [(s, -i) for s, i in sorted(scores, reverse=True)[:7] if s > 0]
        assert [round(s, 9) for s, _ in near] == [s for s, _ in want]
        assert [i for s, i in near if s > near[-1][0]] == [i for s, i in want if s > want[-1][0]]
    assert index.scored < index.asked * (0.6 if block == 8 else 0.8)
    assert index.nearest([asked[0]])[0][:3] == [(1.0, 2), (1.0, 5), (1.0, 8)]


def test_terms_by_hash_and_number():
    words = toxicity.Terms()("Idiot's idiot IDIOTIC x1y")
    assert dict(zip(words[0].tolist(), words[1].tolist(), strict=True)) == {
        int(toxicity.codes_of([t])[0]): n for t, n in {"idiot": 2, "s": 1, "idiotic": 1, "x": 1, "y": 1, "^idio": 3, "^idiot": 3, "^idioti": 1}.items()}
    known = np.sort(toxicity.codes_of(["idiot", "^idio", "other"]))
    numbers, counts = toxicity.Terms(known, frozenset(["idio"]))("idiot idiotic ^idio")
    assert sorted(zip(known[numbers].tolist(), counts.tolist(), strict=True)) == sorted(zip(toxicity.codes_of(["idiot", "^idio"]).tolist(), (1, 3), strict=True))
    assert [len(x) for x in toxicity.Terms(known, frozenset())(None)] == [0, 0]


def test_text_ids_and_shared_labelled_ids(spark):
    texts, toxic = corpus()
    docs = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)] + [("d001", "other text"), (None, texts[0])], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i:03d}", y) for i, y in enumerate(toxic) if i % 3], "id string, y int")
    got = toxicity.score(docs, toxicity.fit(docs.toDF("id", "text"), labels)).collect()
    assert len(got) == len(texts) + 2 and got[0].asDict()["evidence"][0]["example"].startswith("d")
    again = toxicity.score(docs.repartition(7), toxicity.fit(docs.repartition(3).toDF("id", "text"), labels)).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_long_texts_are_no_examples_but_are_scored_whole(spark):
    texts, toxic = corpus()
    docs = documents(spark, [*texts, "word " * 5000 + texts[0]], clash=False)
    labels = spark.createDataFrame([*enumerate(toxic), (len(texts), 1)], "id long, y int")
    index = toxicity.fit(pick(docs, id="doc_id", text="text"), labels, most_chars=2000)
    assert len(texts) not in index.ids and len(index.ids) == len(texts)
    assert toxicity.score(docs.where(f"doc_id = {len(texts)}"), index).first()["evidence"]


def test_a_copy_of_a_toxic_example_with_rare_words_is_found(spark):
    texts, toxic = corpus()
    rare = "Rarely seen are quorvash, bluntrix and zemmolde here."
    docs = documents(spark, [*texts, rare, rare, texts[1]], clash=False)
    labels = spark.createDataFrame([*enumerate(toxic), (len(texts), 1)], "id long, y int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(pick(docs, id="doc_id", text="text"), labels)).collect()}
    copy, clean = got[len(texts) + 1], got[len(texts) + 2]
    assert copy["evidence"][0]["example"] == len(texts) and copy["evidence"][0]["cosine"] == pytest.approx(1) and copy["score"] >= 0.7
    assert clean["evidence"][0]["example"] == 1 and clean["evidence"][0]["cosine"] == pytest.approx(1) and clean["score"] < 0.3


def test_no_labels_score_zero(spark):
    docs = documents(spark, ["some text", None])
    index = toxicity.fit(pick(docs, id="doc_id", text="text"), spark.createDataFrame([], "id long, y int"))
    assert [r["score"] for r in toxicity.score(docs, index).collect()] == [0.0, 0.0]


# ---------------------------------------------------------------- quality

def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 5000):
        starts = quality_cnn.chunk_starts(n)
        assert starts[0] == 0 and starts[-1] + quality_cnn.CHUNK >= n
        assert all(b - a == quality_cnn.CHUNK - quality_cnn.OVERLAP for a, b in zip(starts, starts[1:], strict=False))


def test_gradients_are_the_slopes():
    rng = np.random.default_rng(3)
    net = quality_cnn.Network(filters=4, hidden=3)
    rows, first = rng.integers(97, 123, (5, quality_cnn.CHUNK), dtype=np.uint8), np.array([0, 2, 3])
    y, w = np.array([1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)

    def loss():
        p = net.combine(net.pooled(rows), first)[0]
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())

    g = net.gradients(rows, first, y, w)
    for name in ("w1", "w2", "bias", "table"):
        value = getattr(net, name)
        at = np.unravel_index(np.abs(g[name]).argmax(), value.shape)
        value[at] += 1e-2
        up = loss()
        value[at] -= 2e-2
        down = loss()
        value[at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.15, abs=1e-4)


def test_quality_held_out_and_odd_rows(spark):
    texts, _ = corpus(500)
    good = [i % 4 > 0 for i in range(len(texts))]
    texts = [t if g else " ".join(w + "%%&" for w in t.split()) for t, g in zip(texts, good, strict=True)]
    docs = documents(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good) if i % 5] + [(1, None)], "id long, y int")
    network = quality_cnn.fit(pick(docs, id="doc_id", text="text"), labels)
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score(docs, network).collect()}
    held = [i for i in range(len(texts)) if i % 5 == 0]
    assert sum((got[i] >= 0.5) == good[i] for i in held) >= 0.95 * len(held)
    assert len(got) == len(texts) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    # a long text gives the same features by slices of its chunks
    one = documents(spark, ["long word " * 5000])
    a, b = (quality_cnn.score(one, network, most_chunks=m).first()["score"] for m in (7, 4096))
    assert a == pytest.approx(b, abs=1e-5)
    assert quality_cnn.score(docs.limit(0), network).collect() == []


def test_network_equals_plain_loops(spark):
    """Convolution, pooling and combination of a text, byte by byte."""
    net = quality_cnn.Network(filters=5, hidden=3, seed=4)
    rng = np.random.default_rng(5)
    net.bias = rng.normal(0, 0.5, 5).astype(np.float32)
    texts = ["", "short", "".join(chr(c) for c in rng.integers(32, 300, 1200))]
    scores = []
    for text in texts:
        raw, features, at = text.encode(), [], 0
        while True:
            piece = raw[at:at + 512].ljust(512, b"\0")
            features.append([max(0.0, max(sum(float(net.table[j, piece[p + j], f]) for j in range(6)) + float(net.bias[f])
                                          for p in range(0, 512 - 6 + 1, 2))) for f in range(5)])
            if at + 512 >= len(raw):
                break
            at += 512 - 64
        pooled = [sum(c) / len(features) for c in zip(*features, strict=True)] + [max(c) for c in zip(*features, strict=True)]
        hidden = [np.tanh(sum(x * float(w) for x, w in zip(pooled, net.w1[:, h], strict=True)) + float(net.b1[h])) for h in range(3)]
        scores.append(1 / (1 + np.exp(-(sum(x * float(w) for x, w in zip(hidden, net.w2, strict=True)) + float(net.b2[0])))))
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score(documents(spark, texts), net).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(scores, abs=1e-4)


def test_fit_takes_whole_texts_within_the_bound(spark):
    texts = ["good words here " * 200, "bad bad bad " * 200, "x" * 90]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "id long, y int")
    docs = pick(documents(spark, texts), id="doc_id", text="text")
    seen = []

    class Spy(quality_cnn.Network):
        def fit(self, rows, y, weight, **more):
            seen.extend(len(x) for x in rows)
            return self

    quality_cnn_network, quality_cnn.Network = quality_cnn.Network, Spy
    try:
        quality_cnn.fit(docs, labels)
        assert seen == [len(quality_cnn.chunk_starts(len(t))) for t in texts]
        assert quality_cnn.fit(docs, labels, fit_bytes=100).constant == pytest.approx(1 / 3)   # no good text within the bound
    finally:
        quality_cnn.Network = quality_cnn_network


def test_labels_of_one_class(spark):
    docs = documents(spark, ["text"])
    network = quality_cnn.fit(pick(docs, id="doc_id", text="text"), spark.createDataFrame([(0, 1)], "id long, y int"))
    assert quality_cnn.score(docs, network).first()["score"] == 1.0
