import random

import numpy as np
import pytest

from roomsense.llm import components, near_dup
from tests.llm.helpers import ODD, copies, documents


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(5))))


def brute(texts, percent):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_brute_force(spark, percent):
    texts = copies() + ODD + ODD
    sizes, roots = brute(texts, percent)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(documents(spark, texts), percent=percent).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_large_group_of_unlike_members_in_blocks(spark, monkeypatch):
    """Near copies too far from each other for one star, over several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(130)]
    texts = []
    for _ in range(90):
        text = list(base)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    _, roots = brute(texts, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(documents(spark, texts), percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == roots


@pytest.mark.parametrize("copies_", [120, 240])
def test_a_large_group_enters_the_blocks_once(spark, monkeypatch, copies_):
    """Near copies, some linked with none of the others: rows to be compared stay in proportion to the members, not to their buckets."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(130)]
    texts = []
    for n in range(copies_):
        text = list(base)
        for at in rng.sample(range(130), 5 if n % 10 == 0 else rng.randint(1, 2)):
            text[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    made = {}
    plain = near_dup.written

    def counted(df, name, **options):
        out = plain(df, name, **options)
        made.setdefault(name, out.count())
        return out

    monkeypatch.setattr(near_dup, "written", counted)
    _, roots = brute(texts, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(documents(spark, texts), percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == roots and len(set(roots)) > 2
    assert 0 < made["open-buckets"] <= 2 * len(texts)


def test_long_sets_are_sampled_then_confirmed(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FULL", 32)
    texts = copies(seed=9, groups=4)
    _, roots = brute(texts, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(documents(spark, texts), percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == roots


def test_long_near_copies_are_joined_without_all_their_pairs(spark, monkeypatch):
    """A chain of long texts that no leader reaches, unlike members among them: few pairs leave the blocks."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    chain, text = [], list(rng.choice(words, 600))
    for _ in range(60):
        text = list(text)
        for at in rng.integers(0, len(text), 4):
            text[at] = str(rng.choice(words))
        chain.append(" ".join(text))
    texts = chain + copies(seed=5, groups=2)
    asked = []
    plain = near_dup.verified
    monkeypatch.setattr(near_dup, "FULL", 64)
    monkeypatch.setattr(near_dup, "verified", lambda pairs, *a, **k: asked.append(pairs.count()) or plain(pairs, *a, **k))
    _, roots = brute(texts, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(documents(spark, texts), percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == roots and len(set(roots[:60])) < 60
    assert sum(asked[1:]) < 12 * len(texts)   # all pairs of the chain: 1,770


def test_null_ids_repeats_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(near_dup.near_duplicates(rows).collect(), key=str)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dup.near_duplicates(rows.limit(0)).collect() == []


def test_half_bands_meet_the_miss_probability():
    for percent in (80, 85, 95):
        m = near_dup.half_bands(percent, 4, 1e-4)
        s = (percent / 100) ** 4
        assert 1 - (1 - (1 - s) ** m) ** 2 <= 1e-4 < 1 - (1 - (1 - s) ** (m - 1)) ** 2


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2**63, 200, dtype=np.int64).astype(np.uint64)))
    mh = near_dup.MinHash(64, 4)
    x, y = (np.frombuffer(mh.bands(v)[1], np.uint8) for v in (a, b))
    assert abs((x == y).mean() - 800 / 1200) < 0.08


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
