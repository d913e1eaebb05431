"""The pipeline's stages against their operators' definitions on a small table, and the whole run on the driver's."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roomsense.llm import bpe, toxicity
from tests.llm.helpers import ODD, copies, documents
from tests.llm.test_near_dup import brute
from tests.llm.test_rules_and_licenses import verdict

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns for the driver's documents and some odd rows."""
    own = spark.read.parquet(f"{SF}/documents.parquet")
    more = documents(spark, ODD + copies(groups=3), clash=False).withColumn("doc_id", F.col("doc_id") + 10**6)
    docs = own.unionByName(more.select(own.columns))
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        out.append(docs.collect())
    return out


def test_quality_rules_reject(stages):
    assert sorted(r["doc_id"] for r in stages[1]) == sorted(r["doc_id"] for r in stages[0] if verdict(r["text"])[1])


def test_toxicity_only_removes(stages):
    kept = {r["doc_id"] for r in stages[2]}
    assert kept <= {r["doc_id"] for r in stages[1]} and len(kept) > 0.8 * len(stages[1])


def test_one_document_of_each_group_stays(stages):
    rows = sorted(stages[2], key=lambda r: r["doc_id"])
    _, roots = brute([r["text"] for r in rows], corpus_pipeline.PERCENT)
    assert sorted(r["doc_id"] for r in stages[3]) == [r["doc_id"] for r, root in zip(rows, roots, strict=True) if rows[root]["doc_id"] == r["doc_id"]]
    assert len(stages[3]) < len(rows)


def test_mix_takes_each_document_at_most_twice(stages):
    times = {}
    for r in stages[4]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= {r["doc_id"] for r in stages[3]} and max(times.values()) <= 2
    words = sum(len(r["text"].split()) for r in stages[3])
    assert sum(len(r["text"].split()) for r in stages[4]) == pytest.approx(1.5 * words, rel=0.1)


def test_ids_are_the_library_s(stages):
    coder = bpe.load(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert r["ids"] == coder.lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == texts[r["doc_id"]]


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF)
        assert found.collect() == []
        if n < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns


def keyless(spark, texts, source="s"):
    """Every text under a null id and under the id 7."""
    rows = [(i, t, "en", source, len(t)) for t in texts for i in (None, 7)]
    return spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema)


def test_a_toxic_row_takes_no_other_row_of_its_id(spark, monkeypatch):
    index = toxicity.Index(toxicity.codes_of(["vile"]), frozenset(), np.ones(1), list(range(40)), [1] * 20 + [0] * 20,
                           ([1] * 20 + [0] * 20, [0] * 20, [1] * 20), (1.0, 1.0))
    monkeypatch.setattr(corpus_pipeline, "toxicity_index", lambda spark, sf_dir: index)
    fine = ["some words", "other words"]
    kept = corpus_pipeline.clean(spark, keyless(spark, ["a vile text", *fine]), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted((i, t) for t in fine for i in (0, 7))


def test_unlike_texts_of_one_id_are_all_documents(spark):
    texts = copies(groups=4, size=1)[::2]
    kept = corpus_pipeline.distinct(spark, keyless(spark, [*texts, texts[0]]), SF).collect()
    assert sorted(r["text"] for r in kept if r["doc_id"] == 7) == sorted(texts)
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == sorted([*texts, texts[0]])


def test_mix_meets_its_target_without_ids(spark):
    texts = [f"{'w ' * (i % 5 + 3)}{i}" for i in range(60)]
    taken = [r["text"] for r in corpus_pipeline.mixed(spark, keyless(spark, texts), SF).collect()]
    assert max(taken.count(t) for t in texts) <= 4
    assert sum(len(t.split()) for t in taken) == pytest.approx(1.5 * 2 * sum(len(t.split()) for t in texts), abs=8)


def test_clashing_columns_are_carried_along(spark, monkeypatch):
    index = toxicity.Index(np.empty(0, np.uint64), frozenset(), [], [], [], ([], [], []), (1.0, 1.0))
    monkeypatch.setattr(corpus_pipeline, "toxicity_index", lambda spark, sf_dir: index)
    texts = copies(groups=3, size=2) + ODD
    docs = documents(spark, texts).withColumns({n: F.lit(f"own {n}") for n in ("copy", "copies", "__row", "gone", "c0", "kept", "n_words")})
    rows, twins = docs, documents(spark, texts, clash=False)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows, twins = stage(spark, rows, SF), stage(spark, twins, SF)
        at = rows.columns.index("doc_id")
        assert sorted([r[at] for r in rows.collect()]) == sorted([r["doc_id"] for r in twins.collect()])
        if n < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == docs.columns
            for r in rows.collect():
                assert r["copy"] == "own copy" and r["copies"] == "own copies" and r["TEXT"] == "other" and r["Doc_ID"] == -1 and r["__row"] == "own __row"
