"""Token ids in seekable files: independent zstandard frames, a trailing seek table, a checksum for every frame.

*File.*  Each document's ids, and the end id behind them, are little-endian unsigned 32-bit integers in one or more frames
of their own (``frame_ids`` ids at most), so a reader decompresses only the documents it is asked for.  Behind the frames
stands a skippable frame with the documents' index (id, number of ids, number of frames; compressed), and at the very end the
seek table of zstandard's seekable format: compressed size, size and checksum (low half of XXH64) of each frame.  Any
zstandard program expands the whole file to the plain ids.

*Writing.*  Documents are range-partitioned by (id, hash of the text), so a third of all rows under one id still spreads, and
sorted; a task encodes and streams its documents to files of about ``file_bytes``, a frame at a time.  Files carry names of
the task attempt, and the returned table lists only those of finished attempts: lost executors and repeated tasks leave no
trace.  ``start`` (ids of all files before) comes from sums by file, by task and by groups of 1,024 tasks.

*Reading.*  ``read_files`` opens each file at its end, checks the seek table and the index, reads the frames wanted in spans of
bounded size and checks every frame.  With ``wanted`` ids, files and frames without them are not read.

A null text is empty and holds just the end id; null ids come before all ids; rows of one id are in the order of their
text's hash, then text; repeated rows are written each; an empty table gives no files and an empty result; further columns
are ignored.
"""

from __future__ import annotations

import itertools
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomsense.llm import bpe, bpe_codec
from roomsense.llm.common import arrow_uri, new_path, open_input, open_output, pick, written

#: The seekable format's magic numbers, and one of zstandard's free skippable ones for the index.
SKIPPABLE_SEEK, SEEKABLE, SKIPPABLE_INDEX = 0x184D2A5E, 0x8F92EAB1, 0x184D2A51
CHECKSUMS = 0x80

FILES = "part int, seq int, path string, documents long, ids long, bytes long, first_id long, last_id long, null_ids long"


def checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """One file being written to a stream."""

    def __init__(self, stream, level: int = 3, frame_ids: int = 1 << 20):
        self.stream, self.packer, self.frame_ids = stream, zstandard.ZstdCompressor(level=level), frame_ids
        self.frames: list[tuple[int, int, int]] = []   # compressed size, size, checksum
        self.documents: list[tuple[int | None, int, int]] = []   # id, ids, frames
        self.bytes = 0

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), checksum(raw)))
        self.bytes += len(packed)

    def add(self, doc_id: int | None, arrays) -> None:
        """A document: its ids come as arrays one after another."""
        waiting, n, frames = [], 0, len(self.frames)
        held = 0
        for ids in arrays:
            n += len(ids)
            waiting.append(ids)
            held += len(ids)
            while held >= self.frame_ids:
                whole = np.concatenate(waiting)
                self._frame(whole[:self.frame_ids])
                waiting, held = [whole[self.frame_ids:]], held - self.frame_ids
        if held or len(self.frames) == frames:
            self._frame(np.concatenate([np.empty(0, np.uint32), *waiting]))
        self.documents.append((doc_id, n, len(self.frames) - frames))

    def finish(self) -> None:
        known = np.array([d is not None for d, _, _ in self.documents], "u1")
        ids = np.array([d or 0 for d, _, _ in self.documents], "<i8")
        sizes, frames = (np.array([d[i] for d in self.documents], "<i8") for i in (1, 2))
        plain = b"".join(a.tobytes() for a in (known, ids, sizes, frames))
        index = self.packer.compress(plain)
        self.stream.write(struct.pack("<IIIQ", SKIPPABLE_INDEX, len(index) + 12, checksum(plain), len(self.documents)) + index)
        table = np.array(self.frames, "<u4").tobytes()
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE))


class Reader:
    """One file read by range; ``file`` has ``size()``, ``seek`` and ``read``."""

    def __init__(self, file, name: str = "file"):
        self.file, self.name = file, name
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        self._must(magic == SEEKABLE and flags == CHECKSUMS, "no seek table with checksums at the end")
        at = size - 9 - 12 * n - 8
        head = self._read(at, 8 + 12 * n)
        self._must(struct.unpack_from("<II", head) == (SKIPPABLE_SEEK, 12 * n + 9), "damaged seek table")
        table = np.frombuffer(head, "<u4", offset=8).reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        raw = self._read(int(self.at[-1]), at - int(self.at[-1]))
        kind, length, said, documents = struct.unpack_from("<IIIQ", raw)
        self._must(kind == SKIPPABLE_INDEX and length + 8 == len(raw), "damaged index")
        raw = self._plain(raw[20:], 25 * documents, said)
        self.known = np.frombuffer(raw, "u1", documents).astype(bool)
        self.ids, self.sizes, self.frames = (np.frombuffer(raw, "<i8", documents, documents * (1 + 8 * i)) for i in range(3))
        self._must(int(self.frames.sum()) == n and int(self.sizes.sum()) * 4 == int(self.plain.sum()), "index and seek table differ")
        self.first = np.concatenate([[0], np.cumsum(self.frames)])      # of each document, its first frame
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])       # ids before it

    def _must(self, fine: bool, what: str) -> None:
        if not fine:
            raise ValueError(f"{self.name}: {what}")

    def _read(self, at: int, n: int) -> bytes:
        self._must(at >= 0, "too short")
        self.file.seek(at)
        raw = self.file.read(n)
        self._must(len(raw) == n, "too short")
        return raw

    def _plain(self, packed: bytes, size: int, said: int) -> bytes:
        try:
            raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, size))
        except zstandard.ZstdError as damage:
            raise ValueError(f"{self.name}: damaged frame: {damage}") from damage
        self._must(len(raw) == size and checksum(raw) == said, "a frame's checksum or size is wrong")
        return raw

    def documents(self, which: np.ndarray, span: int = 4 << 20):
        """(number, ids as little-endian bytes) of the documents numbered ``which``, ascending; neighbours are read together."""
        at = 0
        while at < len(which):
            stop = at + 1
            while stop < len(which) and which[stop] == which[stop - 1] + 1 and self.at[self.first[which[stop] + 1]] - self.at[self.first[which[at]]] <= span:
                stop += 1
            low = int(self.at[self.first[which[at]]])
            raw = memoryview(self._read(low, int(self.at[self.first[which[stop - 1] + 1]]) - low))
            for d in which[at:stop].tolist():
                parts = []
                for f in range(int(self.first[d]), int(self.first[d + 1])):
                    a = int(self.at[f]) - low
                    parts.append(self._plain(raw[a:a + int(self.packed[f])], int(self.plain[f]), int(self.sums[f])))
                yield d, b"".join(parts)
            at = stop


def _write(folder: str, tokenizer: str, end_id: int, file_bytes: int, frame_ids: int, piece_chars: int, level: int):
    names = [x.split()[0] for x in FILES.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        coder, part, seq = bpe.load(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        writer = path = stream = None

        def close():
            writer.finish()
            stream.close()
            ids = [d for d, _, _ in writer.documents if d is not None]
            row = (part, seq, path, len(writer.documents), sum(n for _, n, _ in writer.documents), writer.bytes,
                   ids[0] if ids else None, ids[-1] if ids else None, len(writer.documents) - len(ids))
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=pa.schema(
                [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), *((n, pa.int64()) for n in names[3:])]))

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if writer is None:
                    path = f"{folder}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.ids.zst"   # a name of this attempt's own
                    stream = open_output(path)
                    writer = Writer(stream, level, frame_ids)
                writer.add(doc_id, itertools.chain(bpe_codec.id_arrays(coder, text.as_py() or "", piece_chars), [end]))
                if writer.bytes >= file_bytes:
                    yield close()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield close()
    return run


def write_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id",
                text_col: str = "text", file_bytes: int = 64 << 20, frame_ids: int = 1 << 20, piece_chars: int = 1 << 16, level: int = 3) -> DataFrame:
    """Write all documents; returns the files with ``start``, the ids of all files before.  ``folder`` is a path that Spark resolves."""
    spark = docs.sparkSession
    folder = arrow_uri(spark, folder or new_path(spark, "ids"))
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc())
    files = rows.mapInArrow(_write(folder, tokenizer or bpe.default_path(), end_id, file_bytes, frame_ids, piece_chars, level), FILES)
    return written(_with_start(written(files, "id-files")), "id-files-with-start")


def _with_start(files: DataFrame) -> DataFrame:
    """Prefix sums of ids: within a task's files, within 1,024 tasks, and over such groups."""
    def before(*partition):
        w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
        return lambda order: F.coalesce(F.sum("ids").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tasks = files.groupBy("part").agg(F.sum("ids").alias("ids")).withColumn("group", F.floor(F.col("part") / 1024))
    groups = tasks.groupBy("group").agg(F.sum("ids").alias("ids"))
    groups = groups.select("group", before()("group").alias("of_groups"))
    tasks = tasks.withColumn("of_tasks", before("group")("part")).join(groups, "group").select("part", "of_tasks", "of_groups")
    files = files.withColumn("of_files", before("part")("seq")).join(tasks, "part")
    return files.withColumn("start", F.col("of_groups") + F.col("of_tasks") + F.col("of_files")).drop("of_groups", "of_tasks", "of_files")


def read_files(spark: SparkSession, files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers, as binary) of all documents, or of those ``wanted``."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    if wanted is not None:
        wanted = sorted(set(wanted))
        spans = [(F.col("first_id") <= x) & (F.col("last_id") >= x) for x in wanted[:100]]
        if len(spans) == len(wanted):
            files = files.where(F.array_contains(F.array(*spans), True) if spans else F.lit(False))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with open_input(path) as file:
                    reader = Reader(file, path)
                    which = np.arange(len(reader.ids)) if wanted is None else np.nonzero(reader.known & np.isin(reader.ids, wanted))[0]
                    rows, size = [], 0
                    for d, raw in reader.documents(which):
                        rows.append((int(reader.ids[d]) if reader.known[d] else None, start + int(reader.start[d]), int(reader.sizes[d]), raw))
                        size += len(raw)
                        if size >= 4 << 20 or len(rows) >= 5000:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, schema)

    n = max(1, min(100_000, files.count()))
    return files.select("path", "start").repartition(n, F.xxhash64("path")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
