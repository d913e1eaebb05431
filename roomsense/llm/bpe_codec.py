"""BPE encoding and decoding, with tree concatenation for long text.

A text of up to ``piece_chars`` characters without a long unsplit run is encoded at once.  A longer one is cut into
pieces that go to different tasks.  A cut is made at a proven boundary (``bpe.proven``), where ids are simply
concatenated, or, inside a long run that the split pattern does not split, between two characters of one class.  Such
halves are encoded in parallel and joined pairwise as a tree: a window of tokens round the join is encoded again, and
grows until its first token is the left half's own and its last token the right half's own (or it holds the whole run).
A sequence of BPE tokens is the encoding of its bytes exactly if every two neighbours are, so agreement on both sides
proves the joined sequence equal to the encoding of the whole.

Nulls count as empty texts, which have no ids and decode to the empty text; repeated rows give repeated rows; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from roomsense.llm import bpe
from roomsense.llm.common import pick, released

#: Characters needed on both sides of a cut inside a run: longer than any contraction or special token, so that the
#: cut is inside neither.
NEAR = 16


@functools.lru_cache(maxsize=1 << 16)
def char_class(c: str) -> str:
    """The split pattern's class of a character; empty for those at which a cut is never made."""
    if c.isspace():
        return ""
    if c in "'<|>":
        return ""   # contractions and special tokens
    kind = unicodedata.category(c)[0]
    return kind if kind in "LN" else "" if kind in "ZC" else "other"


def inside_run(text: str, p: int) -> bool:
    """True if ``NEAR`` characters before and after ``p`` are of one class, so that no encoding splits at ``p``."""
    if p < NEAR or p + NEAR > len(text):
        return False
    kinds = {char_class(c) for c in text[p - NEAR:p + NEAR]}
    return len(kinds) == 1 and "" not in kinds


class Run:
    """The unsplit run round a place; its characters are looked at once, however often it is cut."""

    def __init__(self, text: str, p: int):
        kind = char_class(text[p])
        a, b = p, p
        while a > 0 and char_class(text[a - 1]) == kind:
            a -= 1
        while b < len(text) and char_class(text[b]) == kind:
            b += 1
        self.low, self.high, self.fine = a, b, True
        if a > 0 and text[a - 1] == " ":
            a -= 1
        # a run after an apostrophe may begin inside a contraction ('s|'t|'re ...): keep the window clear of its letters
        if kind == "L" and a > 0 and text[a - 1] == "'" and (m := re.match(r"s|t|re|ve|m|ll|d", text[a:a + 2])):
            a += m.end()
        # a run of other signs next to a special token's or an apostrophe sign, which belong to the same class: no cut
        if kind == "other":
            self.fine = not (a > 0 and text[a - 1] in "'<|>") and not (b < len(text) and text[b] in "'<|>")
        self.text, self.at, self.before = text, a, 0
        self.total = len(text[a:b].encode()) if self.fine else 0

    def bytes(self, p: int) -> tuple[int, int]:
        """Bytes of the run before and after ``p``, its leading space included; places are asked in ascending order."""
        self.before += len(self.text[self.at:p].encode())
        self.at = p
        return self.before, self.total - self.before


def cuts(text: str, piece_chars: int) -> list[tuple[int, int, int]]:
    """(position, run bytes before, run bytes after) of the cuts; both are 0 at a proven boundary."""
    out, at, n, run = [], 0, len(text), None
    while n - at > piece_chars:
        p = bpe.last_proven(text, at + piece_chars // 2, at + piece_chars + 1)
        if p > 0:
            out.append((p, 0, 0))
        else:
            p = at + piece_chars
            while p < n:
                if bpe.proven(text, p):
                    out.append((p, 0, 0))
                    break
                if inside_run(text, p):
                    if run is None or not run.low <= p < run.high:
                        run = Run(text, p)
                    if run.fine:
                        out.append((p, *run.bytes(p)))
                        break
                    p = run.high
                else:
                    p += 1
            else:
                break
        at = p
    return out


def join(coder: bpe.ByteBpe, left: list[int], right: list[int], before: int, after: int, window: int = 4) -> list[int]:
    """Ids of two halves of a run joined; ``before`` and ``after`` are the run's bytes on both sides.

    Where the run is longer than a half, the half's other end is joined on a later level of the tree.
    """
    if not before or not after:
        return left + right
    k = window
    while True:
        i, size = len(left), 0
        while i > 0 and len(left) - i < k and size < before:
            i -= 1
            size += coder.lengths[left[i]]
        j, far = 0, 0
        while j < len(right) and j < k and far < after:
            far += coder.lengths[right[j]]
            j += 1
        middle = coder.encode_piece(b"".join([coder.table[x] for x in left[i:] + right[:j]]))
        if (i == 0 or size >= before or middle[0] == left[i]) and (j == len(right) or far >= after or middle[-1] == right[j - 1]):
            return left[:i] + middle + right[j:]
        k *= 2


def join_all(coder: bpe.ByteBpe, pieces: list[list[int]], runs: list[tuple[int, int]]) -> list[int]:
    """Join neighbouring pieces pairwise, level by level; ``runs[i]`` belongs to the cut after piece i."""
    while len(pieces) > 1:
        joined, kept = [], []
        for i in range(0, len(pieces) - 1, 2):
            joined.append(join(coder, pieces[i], pieces[i + 1], *runs[i]))
            kept += runs[i + 1:i + 2]
        if len(pieces) % 2:
            joined.append(pieces[-1])
        pieces, runs = joined, kept
    return pieces[0] if pieces else []


def encode_text(coder: bpe.ByteBpe, text: str, piece_chars: int) -> list[int]:
    """Encode one text by its pieces, in this process."""
    at = cuts(text, piece_chars)
    ends = [0, *(p for p, _, _ in at), len(text)]
    return join_all(coder, [coder.encode(text[a:b]) for a, b in zip(ends, ends[1:], strict=False)], [(x, y) for _, x, y in at])


def id_arrays(coder: bpe.ByteBpe, text: str, piece_chars: int):
    """The ids of a text as arrays, one for each stretch between proven boundaries."""
    pieces, runs, at = [], [], 0
    for p, before, after in [*cuts(text, piece_chars), (len(text), 0, 0)]:
        pieces.append(coder.encode(text[at:p]))
        at = p
        if before:
            runs.append((before, after))
        else:
            yield np.array(join_all(coder, pieces, runs), np.uint32)
            pieces, runs = [], []


IDS = pa.list_(pa.int32())


def sha256(ids: np.ndarray) -> str:
    """Lower-case hex SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()


def _id_lists(coder: bpe.ByteBpe, texts: pa.Array) -> pa.Array:
    """The ids of some texts; each text's ids leave Python objects before the next is read."""
    parts, ends = [np.empty(0, np.int32)], [0]
    for text in texts:
        ids = coder.encode(text.as_py())
        parts.append(np.array(ids, np.int32))
        ends.append(ends[-1] + len(ids))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))


def _digests(ids: pa.Array) -> pa.Array:
    flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    return pa.array([sha256(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _encode_whole(path: str, step: int = 512):
    def run(batches):
        coder = bpe.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = _id_lists(coder, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), ids, _digests(ids)], ["id", "ids", "ids_sha256"])
    return run


def _pieces(piece_chars: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("row", pa.int64()), ("piece", pa.int32()), ("before", pa.int64()), ("after", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                at = cuts(x["text"], piece_chars)
                ends = [0, *(p for p, _, _ in at), len(x["text"])]
                runs = [*((b, a) for _, b, a in at), (0, 0)]
                for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    yield pa.RecordBatch.from_pylist([{"id": x["id"], "row": x["row"], "piece": k, "before": runs[k][0], "after": runs[k][1],
                                                       "text": x["text"][a:b]}], schema=schema)
    return run


def _encode_pieces(path: str, step: int = 32):
    def run(batches):
        coder = bpe.load(path)
        keep = ["id", "row", "piece", "before", "after"]
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _id_lists(coder, part.column("text"))], [*keep, "ids"])
    return run


def _join_pieces(path: str, id_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        ids = join_all(bpe.load(path), [r["ids"] for r in rows], [(r["before"], r["after"]) for r in rows[:-1]])
        return pa.table({"id": pa.array([rows[0]["id"]], id_type), "ids": pa.array([ids], IDS),
                         "ids_sha256": pa.array([sha256(np.array(ids, np.int32))])})
    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = 1 << 16) -> DataFrame:
    """``id_col``, ids (array of int) and ids_sha256 of every row.  Only texts longer than ``piece_chars`` are shuffled."""
    from pyspark.sql.pandas.types import to_arrow_type

    path = path or bpe.default_path()
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    long = F.length("text") > piece_chars
    short = rows.where(~long).mapInArrow(released(_encode_whole(path)), f"id {name}, ids array<int>, ids_sha256 string")
    pieces = rows.where(long).withColumn("row", F.monotonically_increasing_id())
    pieces = pieces.mapInArrow(_pieces(piece_chars, arrow), f"id {name}, row long, piece int, before long, after long, text string")
    pieces = pieces.repartition(F.xxhash64("row", "piece"))
    pieces = pieces.mapInArrow(released(_encode_pieces(path)), f"id {name}, row long, piece int, before long, after long, ids array<int>")
    joined = pieces.groupBy("row").applyInArrow(_join_pieces(path, arrow), f"id {name}, ids array<int>, ids_sha256 string")
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded", keep_ids: bool = False,
           step: int = 512) -> DataFrame:
    """Replaces the ids by their text (``keep_ids``: adds it); null ids decode to the empty text.  The other columns stay."""
    path = path or bpe.default_path()
    names = [n for n in encoded.columns if n != ids_col or keep_ids]

    def run(batches):
        coder = bpe.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [coder.decode(x.values.to_pylist() if x.is_valid else []) for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], [*names, out_col])

    schema = StructType([encoded.schema[n] for n in names] + [StructField(out_col, StringType())])
    return encoded.select(*dict.fromkeys([*names, ids_col])).mapInArrow(released(run), schema)
