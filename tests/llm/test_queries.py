"""The registered queries over the driver's smallest tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from roomsense.llm import bpe, queries
from tests.llm.test_near_dup import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
COLUMNS = {
    "op1": ["doc_id", "n_shingles", "component_id", "kept"],
    "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["query_id", "rank", "vec_id", "score"],
    "op7": ["doc_id", "template", "containment", "start_word", "window_words"],
    "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9": ["doc_id", "held_out", "score", "predicted"],
    "op10": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op11": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(n.split("_")[0] for n in names if n[2].isdigit()) == sorted(COLUMNS)
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql()])
def test_columns_and_rows(spark, texts, name):
    df = queries.queries()[name](spark, SF)
    want = COLUMNS[name.split("_")[0]]
    assert [c for c in want if c not in df.columns] == []
    rows = df.collect()
    if name.startswith("op1_"):
        ids = sorted(texts)
        sizes, roots = brute([texts[i] for i in ids], 85)
        got = {r["doc_id"]: r for r in rows}
        assert [got[i]["n_shingles"] for i in ids] == sizes and [got[i]["component_id"] for i in ids] == [ids[r] for r in roots]
    if name.startswith(("op3_", "op4_")):
        lib = bpe.load(bpe.default_path()).lib
        for r in rows:
            ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            if name.startswith("op3_"):
                assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    if name.startswith("op13_"):
        lib, start = bpe.load(bpe.default_path()).lib, 0
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            ids = [*lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    if not name.startswith(("op6_", "op7_", "op10_")):
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
