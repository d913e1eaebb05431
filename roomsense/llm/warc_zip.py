"""WARC records in ZIP packages: writing, and reading by range without extraction.

A package is a ZIP archive of stored (uncompressed) members: ``archive/data.warc.gz`` (one gzip member per record),
``indexes/index.jsonl`` (one line per record: offset and length inside the archive member) and ``datapackage.json``
(which archive goes with which index).  ``write_packages`` streams every partition into packages of bounded size in the
shared folder; a task attempt writes names of its own and only the packages of finished attempts are in the returned
table, so lost executors and repeated tasks leave no trace in the result.

``read_packages`` opens a package, finds the end-of-central-directory record (and its ZIP64 form) from the tail, reads
the central directory, locates the stored archive and index members, and then range-reads the records in spans of
bounded size.  Compressed members are refused, since no range of them can be read alone.

Equal payloads are written once: of the records with one payload the one with the largest page id is the ``response``,
the others are ``revisit`` records that refer to it.  Payloads under ``min_revisit_bytes`` are always responses.  A null
payload is empty; a null id comes before every id; of repeated rows one is the response; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomsense.llm.common import arrow_uri, new_path, open_input, open_output, pick, written

ARCHIVE, INDEX, LISTING = "archive/data.warc.gz", "indexes/index.jsonl", "datapackage.json"
WRITTEN_AT = "1970-01-01T00:00:00Z"   # the same for every run, so reruns give equal packages
EOCD, EOCD64_AT, EOCD64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"


# ------------------------------------------------------------------ records

def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row))}>"


def record(kind: str, row: int, page_id: int | None, url: str | None, payload: bytes, refers_row: int | None, refers_to: int | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(row)), ("WARC-Date", WRITTEN_AT),
              ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload))),
              ("X-Page-Id", "" if page_id is None else str(page_id)),
              ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        fields[3:3] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", record_id(refers_row)), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Package:
    """One package being written; ``finish`` gives its bytes."""

    def __init__(self):
        self.file, self.lines, self.at = io.BytesIO(), [], 0
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, raw: bytes) -> None:
        packed = gzip.compress(raw, 3, mtime=0)
        self.member.write(packed)
        self.lines.append(f'{{"offset": {self.at}, "length": {len(packed)}}}\n')
        self.at += len(packed)

    def finish(self) -> bytes:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.writestr(zipfile.ZipInfo(LISTING), json.dumps({"resources": [{"archive": ARCHIVE, "index": INDEX}]}))
        self.zip.close()
        return self.file.getvalue()


# ------------------------------------------------------------------ ZIP, read by range

class RangeFile:
    """``read(at, n)`` on a file of any file system that Arrow opens by URI (``common.arrow_uri``)."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)


def central_directory(file) -> list[dict]:
    """Members of a ZIP archive: name, method, size and where the local header is, with ZIP64 values resolved."""
    tail_at = max(0, file.size - (22 + 0xFFFF + 20))
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(EOCD)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(EOCD, 0, end)   # the signature can stand in the comment
    if end < 0:
        raise ValueError("no end-of-central-directory record")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20:end - 16] == EOCD64_AT:
        where = struct.unpack_from("<Q", tail, end - 12)[0]
        raw = file.read(where, 56)
        if raw[:4] != EOCD64:
            raise ValueError("no ZIP64 end-of-central-directory record where its locator points")
        count, size, at = struct.unpack_from("<QQQ", raw, 32)
    raw, p, members = file.read(at, size), 0, []
    for _ in range(count):
        if raw[p:p + 4] != ENTRY:
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", raw, p + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, p + 20)
        local, = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46:p + 46 + n_name].decode()
        extra, q = raw[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, q)
            if kind == 1:   # ZIP64: only the values that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            q += 4 + length
        members.append({"name": name, "method": method, "size": packed, "local": local})
        p += 46 + n_name + n_extra + n_comment
    return members


def stored_at(file, member: dict) -> int:
    """Where a stored member's bytes begin."""
    if member["method"] != 0:
        raise ValueError(f"{member['name']} is compressed; only stored members can be read by range")
    head = file.read(member["local"], 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member['name']}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member["local"] + 30 + n_name + n_extra


def lines_of(file, at: int, size: int, step: int = 1 << 20):
    """Lines of a member, read in ranges."""
    rest, end = b"", at + size
    while at < end:
        raw = file.read(at, min(step, end - at))
        at += len(raw)
        *full, rest = (rest + raw).split(b"\n")
        yield from full
    if rest:
        yield rest


def records(file, span: int = 4 << 20):
    """(fields, payload) of the records of a package, by its indexes, in range reads of about ``span`` bytes."""
    members = {m["name"]: m for m in central_directory(file)}
    listing = members[LISTING]
    for pair in json.loads(file.read(stored_at(file, listing), listing["size"]))["resources"]:
        archive, index = members[pair["archive"]], members[pair["index"]]
        base = stored_at(file, archive)
        group: list[tuple[int, int]] = []

        def flush(group, base=base):
            if group:
                start, stop = group[0][0], group[-1][0] + group[-1][1]
                raw = file.read(base + start, stop - start)
                for at, n in group:
                    yield parse_record(zlib.decompress(raw[at - start:at - start + n], 31))

        for line in lines_of(file, stored_at(file, index), index["size"]):
            x = json.loads(line)
            if x["offset"] + x["length"] > archive["size"]:
                raise ValueError(f"index points beyond {pair['archive']}")
            if group and (x["offset"] != group[-1][0] + group[-1][1] or x["offset"] + x["length"] - group[0][0] > span):
                yield from flush(group)
                group = []
            group.append((x["offset"], x["length"]))
        yield from flush(group)


# ------------------------------------------------------------------ Spark

def _decided(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """Each row with its kind and, for revisits, the response's row and page id.

    Only keys (row, page id, digest) are compared: the largest id per payload is an aggregate that combines before
    its shuffle, and it is joined back to the keys alone, where a hot payload's partition may be split.  Payloads are then shuffled
    once, by row.
    """
    keys = written(pages.select("row", "page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
                   .where(F.col("n") >= min_revisit_bytes), "payload-keys")
    first = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id"), F.col("row"))
    groups = keys.groupBy("sha1", "n").agg(F.max(first).alias("best"), F.count("*").alias("copies")).where("copies > 1")
    copies = (keys.select("row", "sha1", "n").join(groups, ["sha1", "n"]).where(F.col("row") != F.col("best.row"))
              .select("row", F.col("best.row").alias("refers_row"), F.col("best.page_id").alias("refers_to")))
    return (pages.join(copies, "row", "left")
            .withColumn("kind", F.when(F.col("refers_row").isNull(), "response").otherwise("revisit")))


def _write(folder: str, package_bytes: int):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def close(package):
        raw = package.finish()
        uri = f"{folder}/{uuid.uuid4().hex}.zip"   # a name of this attempt's own
        with open_output(uri) as out:
            out.write(raw)
        return pa.RecordBatch.from_pylist([{"path": uri, "records": len(package.lines), "bytes": len(raw)}], schema=schema)

    def run(batches):
        package = None
        for batch in batches:
            cols = [batch.column(c) for c in ("kind", "row", "page_id", "url", "payload", "refers_row", "refers_to")]
            for i in range(batch.num_rows):
                package = package or Package()
                package.add(record(*(c[i].as_py() for c in cols)))
                if package.at >= package_bytes:
                    yield close(package)
                    package = None
        if package:
            yield close(package)
    return run


def write_packages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit_bytes: int = 0, package_bytes: int = 32 << 20) -> DataFrame:
    """Write every row as a record; returns the packages: path, records, bytes.  ``folder`` is a path that Spark resolves."""
    spark = pages.sparkSession
    folder = arrow_uri(spark, folder or new_path(spark, "warc"))
    rows = pick(pages, page_id=id_col, url=url_col, payload=payload_col)
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"),
                       F.monotonically_increasing_id().alias("row"))
    # keys and records are both read from this table: another job over the input may number its rows otherwise
    rows = written(rows, "numbered-pages", compression="zstd")
    packages = _decided(rows, min_revisit_bytes).mapInArrow(_write(folder, package_bytes), "path string, records long, bytes long")
    return written(packages, "warc-packages")


def read_packages(spark: SparkSession, packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the packages: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, unless switched
    off, payload (null for revisits).  The digest of each response's payload is checked."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] * payloads)])

    def number(x):
        return int(x) if x else None

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for fields, payload in records(RangeFile(path)):
                    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    length = int(fields["x-payload-length"])
                    if kind == "response" and (digest(payload) != said or len(payload) != length):
                        raise ValueError(f"{path}: the payload of {fields['warc-record-id']} is damaged")
                    rows.append({"page_id": number(fields["x-page-id"]), "url": fields["warc-target-uri"], "record_type": kind,
                                 "payload_bytes": length, "payload_digest": said, "refers_to": number(fields.get("x-refers-to-page")),
                                 **({"payload": payload if kind == "response" else None} if payloads else {})})
                    size += len(payload)
                    if len(rows) >= 5000 or size >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    n = max(1, min(10_000, packages.count()))
    return packages.select("path").repartition(n, F.xxhash64("path")).mapInArrow(run, out + ", payload binary" * payloads)
