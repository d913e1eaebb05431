import pytest

from roomsense.llm import mixing
from tests.llm.helpers import documents


def level(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("sources", [("x",), ("é", "z", "a", "B", None, "", "q")])
def test_targets_and_taken_words(spark, sources):
    texts = [None, "", " \n"] + ["w " * (1 + (i * 37) % 90) for i in range(400)] + ["w w w"] * 600
    rows = mixing.mix(documents(spark, texts, sources), cell_rows=64).collect()
    assert len(rows) == len(texts)
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["copies"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
    want = level(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 4
    again = mixing.mix(documents(spark, texts, sources), cell_rows=64).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_no_rows_and_no_words(spark):
    assert mixing.mix(documents(spark, ["a"]).limit(0)).collect() == []
    rows = mixing.mix(documents(spark, [None, "", "  "])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in rows] == [(0, 0.0, 0)] * 3
