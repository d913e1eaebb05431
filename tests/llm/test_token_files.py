"""Token-id files: round trips, standard readers, damage, and the place of every document."""

import io
import zlib

import numpy as np
import pytest
import zstandard

from roomsense.llm import bpe, common, token_files
from tests.llm.helpers import ODD, documents


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def packed(docs, **options):
    out = io.BytesIO()
    writer = token_files.Writer(out, **options)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.finish()
    return out.getvalue()


DOCS = [(3, [np.arange(10), np.array([], int), np.arange(25)]), (None, []), (8, [np.array([2 ** 32 - 1, 0])]), (8, [np.arange(64)])]


@pytest.mark.parametrize("frame_ids", [1, 8, 1 << 20])
def test_round_trip_and_plain_zstandard(frame_ids):
    raw = packed(DOCS, frame_ids=frame_ids)
    plain = [np.concatenate([np.empty(0, int), *a]).astype("<u4").tobytes() for _, a in DOCS]
    reader = token_files.Reader(Bytes(raw))
    for span in (1, 50, 1 << 20):
        assert [b for _, b in reader.documents(np.arange(4), span)] == plain
        assert list(reader.documents(np.array([0, 3]), span)) == [(0, plain[0]), (3, plain[3])]
    assert [int(i) if k else None for i, k in zip(reader.ids, reader.known, strict=True)] == [3, None, 8, 8]
    assert reader.start.tolist() == [0, 35, 35, 37, 101]
    # any zstandard reader expands the whole file: both trailing frames are skippable
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(plain)


def test_only_wanted_frames_are_read():
    raw = packed([(i, [np.random.default_rng(i).integers(0, 50_000, 2000)]) for i in range(50)])

    class Counting(Bytes):
        got = 0

        def read(self, n=-1):
            self.got += n
            return super().read(n)

    file = Counting(raw)
    reader = token_files.Reader(file)
    opened = file.got
    assert len(list(reader.documents(np.array([20])))) == 1
    assert file.got - opened < len(raw) / 40 and opened < len(raw) / 40


def test_damage_is_found():
    raw = packed(DOCS)
    for at in (6, len(raw) - 1, len(raw) - 12, raw.index(b"\x51\x2a\x4d\x18") + 25):
        bad = bytearray(raw)
        bad[at] ^= 0x55
        with pytest.raises(ValueError, match="file: "):
            list(token_files.Reader(Bytes(bytes(bad))).documents(np.arange(4)))
    for part in (raw[:-3], raw[:5], b""):
        with pytest.raises(ValueError, match="file: "):
            token_files.Reader(Bytes(part))


def test_files_of_odd_rows(spark, tmp_path):
    texts = ODD + ODD[:3] + ["word " * 3000, "y" * 9000, "<|endoftext|> a"]
    docs = documents(spark, texts)
    extra = spark.createDataFrame([(None, "no id", "en", "s", 1), (2, "same id", "en", "s", 1), (2, "same id", "en", "s", 1)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    plain = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], extra.schema).unionByName(extra)
    lib = bpe.load(bpe.default_path()).lib

    def ids(text):
        return [*lib.encode(text or "", add_special_tokens=False).ids, 0]

    for df, more in ((docs, []), (plain, [(None, "no id"), (2, "same id"), (2, "same id")])):
        files = token_files.write_files(df.repartition(4), folder=str(tmp_path / f"f{len(more)}"), file_bytes=40, piece_chars=512)
        assert files.count() > 3
        got = sorted(token_files.read_files(spark, files).collect(), key=lambda r: r["start"])
        assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
        keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
        assert keys == sorted(keys)   # null ids first, then ascending
        want = sorted([(i, ids(t)) for i, t in enumerate(texts)] + [(i, ids(t)) for i, t in more], key=repr)
        assert sorted([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got], key=repr) == want
        assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
        some = token_files.read_files(spark, files, wanted=[2, 5, 999]).collect()
        assert sorted((r["doc_id"], r["start"]) for r in some) == sorted((r["doc_id"], r["start"]) for r in got if r["doc_id"] in (2, 5))
        assert token_files.read_files(spark, files, wanted=[]).collect() == []
    empty = token_files.write_files(docs.limit(0))
    assert empty.count() == 0 and token_files.read_files(spark, empty).collect() == []


def test_starts_over_groups_of_tasks(spark):
    rng = np.random.default_rng(0)
    rows = [(p, s, int(rng.integers(0, 9))) for p in (0, 1, 5, 1023, 1024, 1025, 4000) for s in range(3)]
    got = token_files._with_start(spark.createDataFrame(rows, "part int, seq int, ids long")).collect()
    before = dict(zip([r[:2] for r in rows], np.cumsum([0, *(r[2] for r in rows)])[:-1].tolist(), strict=True))
    assert {(r["part"], r["seq"]): r["start"] for r in got} == before


def test_crc_of_the_query(spark):
    from pyspark.sql import functions as F
    files = token_files.write_files(documents(spark, ["one two"], clash=False))
    row = token_files.read_files(spark, files).withColumn("crc", F.crc32("ids")).first()
    assert row["crc"] == zlib.crc32(bytes(row["ids"]))


def test_paths_are_those_of_spark(spark):
    assert common.arrow_uri(spark, "/a b/c") == "file:///a b/c"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://cluster/")
    conf.set("fs.viewfs.mounttable.cluster.link./shared", "file:///tmp")
    try:
        assert common.arrow_uri(spark, "/shared/x") == "viewfs://cluster/shared/x"   # not the machine's own disk
        assert common.arrow_uri(spark, "file:/a") == "file:///a"
    finally:
        conf.set("fs.defaultFS", before)
    with pytest.raises(ValueError, match="is on"):
        common.arrow_uri(spark, "webhdfs://127.0.0.1:1/x")


def test_what_is_written_is_registered_for_deletion(spark):
    path = common.new_path(spark, "probe")
    home = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(home) and files.cancelDeleteOnExit(home)   # true only for a registered path
    files.delete(home, True)
