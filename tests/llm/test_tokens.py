import hashlib
import random

import numpy as np
import pytest

from roomsense.llm import bpe, bpe_codec, token_counts
from tests.llm.helpers import ODD, documents

ALPHABETS = ["abc", "aab ", "x1", "字漢,。", "!!--", "the ing er on 'd 's", "éàß ", "0123", "\n\t  a", "ab'recd", "\U0001F600á"]


@pytest.fixture(scope="module")
def coder():
    return bpe.load(bpe.default_path())


def reference(coder, text):
    return coder.lib.encode(text, add_special_tokens=False).ids


def texts(n=300, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        letters = rng.choice(ALPHABETS)
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 250)))
        if rng.random() < 0.3:
            text += rng.choice(["<|endoftext|>", "'re", "'s ", "<|endof"]) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        out.append(text)
    return out


def test_pieces_join_to_the_library_s_ids(coder):
    for text in texts():
        ids = reference(coder, text)
        assert coder.encode(text) == ids
        for size in (8, 40, 64):
            assert bpe_codec.encode_text(coder, text, size) == ids, (size, text)
        assert coder.decode(ids) == coder.lib.decode(ids, skip_special_tokens=False)


def test_long_unsplit_run_is_a_tree(coder):
    for text in ("a" * 5000, "ab" * 3000, "字" * 2000, "xyzzy" * 700 + " end"):
        assert len(bpe_codec.cuts(text, 256)) > 3
        assert bpe_codec.encode_text(coder, text, 256) == reference(coder, text)


def test_cutting_an_unsplit_run_looks_at_each_character_once(monkeypatch):
    looked = []
    plain = bpe_codec.char_class
    monkeypatch.setattr(bpe_codec, "char_class", lambda c: looked.append(c) or plain(c))
    for text in ("ab" * 20_000, "字" * 40_000, "-" * 20_000 + "'" + "-" * 20_000):
        for n in (1, 4):
            looked.clear()
            bpe_codec.cuts(text * n, 256)
            assert len(looked) < 1.6 * len(text) * n + 200


def test_overlapping_chunks_count_like_the_library(coder):
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join(rng.choice(["the", "ing", "Été", "don't", "<|endoftext|>", "1234", "--", "x" * 30]) for _ in range(300))
        for size, overlap in ((400, 80), (300, 100)):
            bounds = token_counts.chunk_bounds(len(text), size, overlap)
            assert bounds[0][0] == 0 and bounds[-1][1] == len(text) and len(bounds) > 2
            rows = []
            for k, (a, b) in enumerate(bounds):
                ids = coder.encode(text[a:b])
                left, right = token_counts.boundaries(text[a:b], ids, coder.lengths, k == 0, k == len(bounds) - 1, 2 * overlap)
                rows.append({"tokens": len(ids), "left_at": [a + p for p, _ in left], "left_n": [n for _, n in left],
                             "right_at": [a + p for p, _ in right], "right_n": [n for _, n in right]})
            n = token_counts.splice(rows)
            assert n is None or n == len(reference(coder, text))


def test_encode_decode_query_over_odd_rows(spark, coder):
    rows = ODD + ODD[:3] + ["word " * 3000, "y" * 9000]
    got = {r["doc_id"]: r for r in bpe_codec.decode(bpe_codec.encode(documents(spark, rows), piece_chars=512)).collect()}
    for i, text in enumerate(rows):
        ids = np.array(reference(coder, text or ""), "<u4")
        assert got[i]["decoded"] == (text or "") and got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
    assert bpe_codec.encode(documents(spark, rows).limit(0)).collect() == []


def test_counts_widen_where_no_boundary_is_proven(spark, coder):
    rows = ODD + ["word " * 3000, "z" * 9000, "abc" * 500 + " " + "word " * 900]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(documents(spark, rows), chunk_chars=600, overlap=64).collect()}
    assert [got[i]["n_tokens"] for i in range(len(rows))] == [len(reference(coder, t or "")) for t in rows]
    assert [got[i]["n_bytes"] for i in range(len(rows))] == [len((t or "").encode()) for t in rows]
    assert token_counts.count_tokens(documents(spark, rows).limit(0)).collect() == []
