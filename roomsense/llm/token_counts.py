"""Token counts by overlap resynchronisation.

Texts of up to ``chunk_chars`` characters are encoded whole.  A longer text is cut into chunks that overlap by
``2 * overlap`` characters; chunks go to different tasks and are encoded one by one.  In an overlap both chunks give
token boundaries with their offsets; the chunks are spliced at the first boundary that both have and that is proven
stable (``bpe.proven``: a place every encoding must split at, away from the chunks' ends).  Where an overlap holds no
such place the document comes again with overlaps eight times as wide, at last as one chunk, so no text is refused.

Nulls count as empty texts; an empty text has 0 tokens; a repeated row gives a repeated row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomsense.llm import bpe
from roomsense.llm.common import pick, written

#: A chunk's boundaries this close to its own end are not used: longer than any special token or contraction.
MARGIN = 32


def chunk_bounds(length: int, chunk_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Character ranges of overlapping chunks; neighbours share ``2 * overlap`` characters round each cut."""
    cuts = list(range(0, length, chunk_chars)) or [0]
    if len(cuts) > 1 and length - cuts[-1] <= overlap:
        cuts.pop()
    ends = [*cuts[1:], length]
    return [(max(0, a - overlap), min(length, b + overlap)) for a, b in zip(cuts, ends, strict=True)]


def boundaries(text: str, ids: list[int], lengths: list[int], first: bool, last: bool, width: int) -> list[list[tuple[int, int]]]:
    """(offset, tokens before it) of the proven token boundaries in the chunk's first and last ``width`` characters."""
    raw = text.encode()
    ascii_only = len(raw) == len(text)
    ends = list(itertools.accumulate(lengths[i] for i in ids))
    out: list[list[tuple[int, int]]] = [[], []]
    for side, (low, high) in enumerate(((MARGIN, width - MARGIN), (len(text) - width + MARGIN, len(text) - MARGIN))):
        if (side == 0 and first) or (side == 1 and last):
            continue
        at = {(p if ascii_only else len(text[:p].encode())): p for p in range(max(1, low), min(high, len(text))) if bpe.proven(text, p)}
        out[side] = [(at[e], n + 1) for n, e in enumerate(ends) if e in at]
    return out


def _whole(path: str):
    def run(batches):
        coder = bpe.load(path)
        for batch in batches:
            n = [len(coder.encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])
    return run


def _chunks(chunk_chars: int, overlap: int):
    names = ["row", "chunk", "chunks", "start", "text"]

    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                bounds = chunk_bounds(len(text), chunk_chars, overlap)
                for k, (a, b) in enumerate(bounds):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (row, k, len(bounds), a, text[a:b]), strict=True))],
                                                     schema=pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("chunks", pa.int64()),
                                                                       ("start", pa.int64()), ("text", pa.string())]))
    return run


def _encode_chunks(path: str, overlap: int):
    pair = pa.list_(pa.int64())
    schema = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("tokens", pa.int64()),
                        ("left_at", pair), ("left_n", pair), ("right_at", pair), ("right_n", pair)])

    def run(batches):
        coder = bpe.load(path)
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                ids = coder.encode(x["text"])
                left, right = boundaries(x["text"], ids, coder.lengths, x["chunk"] == 0, x["chunk"] == x["chunks"] - 1, 2 * overlap)
                rows.append({"row": x["row"], "chunk": x["chunk"], "tokens": len(ids),
                             "left_at": [x["start"] + p for p, _ in left], "left_n": [n for _, n in left],
                             "right_at": [x["start"] + p for p, _ in right], "right_n": [n for _, n in right]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def splice(chunks: list[dict]) -> int | None:
    """Tokens of a document from its chunks in order; None if two neighbours have no proven boundary in common."""
    total, skip = 0, 0
    for a, b in itertools.pairwise(chunks):
        right = dict(zip(a["right_at"], a["right_n"], strict=True))
        common = next(((n, m) for p, m in zip(b["left_at"], b["left_n"], strict=True) if (n := right.get(p)) is not None), None)
        if common is None:
            return None
        total += common[0] - skip
        skip = common[1]
    return total + chunks[-1]["tokens"] - skip


def _splice(key, pdf):
    import pandas as pd

    n = splice(pdf.sort_values("chunk").to_dict("records"))
    return pd.DataFrame({"row": [key[0]], "n_tokens": pd.array([n], dtype="Int64")})


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = 1 << 16, overlap: int = 256) -> DataFrame:
    """``id_col``, n_bytes, n_tokens of every row.  Only texts longer than ``chunk_chars`` are shuffled."""
    path = path or bpe.default_path()
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = rows.schema["id"].dataType.simpleString()
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(_whole(path), f"id {id_type}, n_bytes long, n_tokens long")
    long = written(rows.where(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    counted, left = None, long
    longest = long.agg(F.max(F.length("text"))).first()[0] or 0
    while longest:
        size = chunk_chars if overlap < chunk_chars else longest + 1
        parts = left.select("row", "text").mapInArrow(_chunks(size, overlap), "row long, chunk long, chunks long, start long, text string")
        parts = parts.repartition(F.xxhash64("row", "chunk"))
        done = parts.mapInArrow(_encode_chunks(path, overlap), "row long, chunk long, tokens long, left_at array<long>, "
                                "left_n array<long>, right_at array<long>, right_n array<long>")
        done = written(done.groupBy("row").applyInPandas(_splice, "row long, n_tokens long"), "spliced")
        good = done.where("n_tokens is not null")
        counted = good if counted is None else counted.unionByName(good)
        missed = done.where("n_tokens is null").select("row")
        if missed.isEmpty():
            break
        left, overlap = left.join(missed, "row", "left_semi"), overlap * 8
    if counted is not None:
        counted = long.join(counted, "row").select("id", "n_bytes", "n_tokens")
        short = short.unionByName(counted)
    return short.withColumnRenamed("id", id_col)
