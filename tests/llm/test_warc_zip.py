import base64
import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from roomsense.llm import warc_zip


class Memory:
    def __init__(self, raw):
        self.raw, self.size, self.most = raw, len(raw), 0

    def read(self, at, n):
        self.most = max(self.most, n)
        return self.raw[at:at + n]


def package(n=200):
    p = warc_zip.Package()
    for i in range(n):
        p.add(warc_zip.record("response", i, i, f"http://x/{i}", b"payload %d \r\n\r\n WARC/1.1" % i * 20, None, None))
    return p.finish()


def test_records_come_back_in_bounded_ranges():
    file = Memory(package())
    got = list(warc_zip.records(file, span=2000))
    assert [int(f["x-page-id"]) for f, _ in got] == list(range(200))
    assert all(p == b"payload %d \r\n\r\n WARC/1.1" % i * 20 for i, (_, p) in enumerate(got))


def test_zip64_directory_and_comment():
    raw = package(3)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        z.testzip()
    at = raw.rfind(b"PK\x05\x06")
    count, size, where = struct.unpack_from("<HII", raw, at + 10)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, where)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1)
    comment = b"note PK\x05\x06 inside"
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment
    wide = raw[:at] + end64 + locator + end
    assert warc_zip.central_directory(Memory(wide)) == warc_zip.central_directory(Memory(raw))
    assert len(list(warc_zip.records(Memory(wide)))) == 3


def test_zip64_sizes_in_the_extra_field():
    name, big = b"archive/data.warc.gz", 5 << 32
    extra = struct.pack("<HHQQQ", 1, 24, big, big, big + 7)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    directory = entry + name + extra
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 1, 1, len(directory), 0, 0)
    assert warc_zip.central_directory(Memory(directory + end)) == [{"name": name.decode(), "method": 0, "size": big, "local": big + 7}]


def test_compressed_members_and_damage_are_refused():
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.LISTING, "x" * 1000)
    memory = Memory(file.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.stored_at(memory, warc_zip.central_directory(memory)[0])
    with pytest.raises(ValueError, match="end-of-central"):
        warc_zip.central_directory(Memory(b"no archive"))


def test_write_and_read_pages(spark):
    same = "<html>same</html>"
    rows = [(1, "u", same), (2, "u\r\nX: y", same), (3, None, same), (4, "v", None), (5, "w", ""), (6, "x", "é" * 9000), (6, "x", "é" * 9000), (None, "n", same), (None, "n", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Payload", F.lit(1)).withColumn("kind", F.lit("x"))
    packages = warc_zip.write_packages(df, package_bytes=300)
    assert packages.agg(F.sum("records")).first()[0] == len(rows) and packages.count() > 1
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"], r["payload_digest"]) for r in warc_zip.read_packages(spark, packages).collect())

    def mark(text):
        raw = (text or "").encode()
        return len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()

    want = [(1, "revisit", 3, *mark(same)), (2, "revisit", 3, *mark(same)), (3, "response", 0, *mark(same)), (4, "revisit", 5, *mark("")), (5, "response", 0, *mark("")),
            (6, "response", 0, *mark(rows[5][2])), (6, "revisit", 6, *mark(rows[5][2])), (0, "revisit", 3, *mark(same)), (0, "response", 0, *mark("alone"))]
    assert got == sorted(want)
    small = warc_zip.read_packages(spark, warc_zip.write_packages(df, min_revisit_bytes=10**6)).collect()
    assert {r["record_type"] for r in small} == {"response"}
    assert warc_zip.read_packages(spark, warc_zip.write_packages(df.limit(0))).collect() == []


def test_rows_keep_their_numbers_when_later_scans_are_split_otherwise(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "same" if i % 7 == 0 else f"page {i} " * 50) for i in range(80)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16).write.parquet(str(tmp_path / "pages"))
    kept, write = spark.conf.get("spark.sql.files.maxPartitionBytes"), warc_zip.written

    def shifting(df, name, **options):
        out = write(df, name, **options)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return out

    monkeypatch.setattr(warc_zip, "written", shifting)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        packages = warc_zip.write_packages(spark.read.parquet(str(tmp_path / "pages")))
        got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc_zip.read_packages(spark, packages).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == {i: ("revisit", 77) if i % 7 == 0 and i != 77 else ("response", None) for i in range(80)}
