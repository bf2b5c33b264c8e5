"""WARC records in ZIP packages: writer, and reader by byte ranges.

A package is a ZIP archive whose members are stored, not compressed: one
archive member (``.warc.gz``, one gzip member per record) and one index member
(a line per record: place, length, id). The reader takes the end record, the
ZIP64 records where there are any and the central directory, finds the index
member's bytes in the package, and then reads each record by its own range; no
member is extracted.

Files are reached through pyarrow file systems by URI, so a package may lie
wherever the executors can reach it. Tasks write under names of their own
attempt and return the name; only packages named by finished tasks are read, so
an attempt that was lost leaves at most an unread file.

Defined results: a null payload counts as empty; repeated rows are records of
their own and the later ones revisit the first; rows with a null id are written
with an empty id and read back as null; an empty table makes no package and an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Signatures and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
BIG16, BIG32 = 0xFFFF, 0xFFFFFFFF


# ---------------------------------------------------------------------------
# ZIP
# ---------------------------------------------------------------------------

class PackageWriter:
    """A ZIP archive of stored members, written front to back."""

    def __init__(self, sink, zip64_from: int = BIG32):
        self.sink, self.at, self.members, self.limit = sink, 0, [], zip64_from

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def member(self, name: str, chunks) -> None:
        """Add a member whose size is known only afterwards: sizes and checksum
        follow it in a data descriptor with 64-bit sizes."""
        raw, start = name.encode(), self.at
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 33, 0, BIG32, BIG32, len(raw), 20) + raw
                  + struct.pack("<HHQQ", 1, 16, 0, 0))
        crc, begun = 0, self.at
        for c in chunks:
            crc = zlib.crc32(c, crc)
            self._put(c)
        size = self.at - begun
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        directory = self.at
        for raw, crc, size, start in self.members:
            big = [x for x in (size, size, start) if x >= self.limit]
            extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
            low = [BIG32 if x >= self.limit else x for x in (size, size, start)]
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 33, crc, low[0], low[1],
                                  len(raw), len(extra), 0, 0, 0, 0, low[2]) + raw + extra)
        size, n = self.at - directory, len(self.members)
        if n >= BIG16 or size >= self.limit or directory >= self.limit:
            at = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, directory))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, at, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, min(n, BIG16), min(n, BIG16), min(size, BIG32),
                              BIG32 if directory >= self.limit else directory, 0))


class PackageReader:
    """Members of a ZIP archive by range reads of a seekable source."""

    def __init__(self, source):
        self.source = source
        total = source.size()
        tail_at = max(0, total - 22 - BIG16)
        tail = self.read(tail_at, total - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        if at < 0:
            raise ValueError("no end of central directory")
        n, size, start = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and struct.unpack_from("<I", tail, at - 20)[0] == LOCATOR64:
            place = struct.unpack_from("<Q", tail, at - 12)[0]
            n, size, start = struct.unpack_from("<QQQ", self.read(place, 56), 32)
        self.members = dict(self._directory(self.read(start, size), n))

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    @staticmethod
    def _directory(raw: bytes, n: int):
        at = 0
        for _ in range(n):
            (sign, _, _, flags, method, _, _, _, packed, size, name_n, extra_n, comment_n, _, _, _,
             start) = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
            if sign != CENTRAL:
                raise ValueError("bad central directory")
            name = raw[at + 46:at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + name_n:at + 46 + name_n + extra_n], 0
            while k + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, k)
                if tag == 1:  # 64-bit values stand for the saturated fields, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                    size, packed, start = (next(values) if v == BIG32 else v for v in (size, packed, start))
                k += 4 + length
            yield name, (method, packed, start)
            at += 46 + name_n + extra_n + comment_n

    def place(self, name: str) -> tuple[int, int]:
        """(first byte, size) of a stored member's content in the package."""
        method, size, start = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed, not stored")
        name_n, extra_n = struct.unpack_from("<HH", self.read(start, 30), 26)
        return start + 30 + name_n + extra_n, size


# ---------------------------------------------------------------------------
# WARC
# ---------------------------------------------------------------------------

def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str, date: str, payload: bytes, length: int, digest: str,
                 refers_to: str | None = None) -> bytes:
    """One record. A revisit has no block; headers give the digest and length
    of the payload it stands for."""
    block = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", date),
            ("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(length))]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, rest[:int(fields["content-length"])]


def _bare(urn: str | None) -> str | None:
    return None if urn is None else urn.removeprefix("<urn:page:").removesuffix(">")


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def revisits(pages: DataFrame, id_col: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Row numbers of the pages that revisit an earlier equal payload.

    First a count and the least id per digest (summed by the tasks before the
    shuffle, so a digest that a third of the pages share is one row a task);
    then only the rows of repeated digests meet their first id, as narrow rows.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    keys = pages.select("__row", F.col(id_col).alias("__id"), F.sha2(body, 256).alias("__key"),
                        F.octet_length(body).alias("__n")).where(F.col("__n") >= min_bytes)
    first = (keys.groupBy("__key").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("__first"),
                                       F.count("*").alias("__count"))
             .where("__count > 1").select("__key", F.col("__first.__id").alias("__refers"),
                                          F.col("__first.__row").alias("__first_row")))
    return (keys.join(first, "__key").where("__row <> __first_row")
            .select("__row", F.coalesce(F.col("__refers").cast("string"), F.lit("")).alias("__refers")))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", uri: str = "url", payload: str = "html",
                   min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write the records, one package a task, and return (path, records).

    ``folder`` is a URI that every executor can write to. Rows are told apart
    by their place in ``pages``, so that must be a stored table or a frame that
    is computed alike each time.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col), F.col(uri), F.col(payload)).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.join(revisits(rows, id_col, payload, min_bytes), "__row", "left").select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(uri).cast("string"), F.lit("")),
        F.coalesce(F.col(payload), F.lit("")), "__refers")

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)

    def write(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        store, base = fs.FileSystem.from_uri(folder)
        name, lines = f"{base}/{uuid.uuid4().hex}.zip", []

        def records():
            at = 0
            for b in itertools.chain([first], batches):
                for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                    raw = html.encode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    rec = packer.compress(record_bytes("response" if refers is None else "revisit", page, url, date, raw,
                                                       len(raw), sha1_base32(raw), refers)) + packer.flush()
                    lines.append(f"{at} {len(rec)} {page}\n")
                    at += len(rec)
                    yield rec

        with store.open_output_stream(name) as sink:
            out = PackageWriter(sink)
            out.member("archive/data.warc.gz", records())
            out.member("indexes/index.txt", ["".join(lines).encode()])
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64())], ["path", "records"])

    return rows.mapInArrow(write, "path string, records long")


def read_packages(packages: DataFrame, folder: str, id_type: str = "long", run: int = 2000) -> DataFrame:
    """(path) rows to one row per record: id, uri, record_type, payload_bytes,
    payload_digest, refers_to, payload (null for a revisit).

    Indexes are read first and dealt out in runs of records, so that one large
    package is read by many tasks.
    """
    def index(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as f:
                    z = PackageReader(f)
                    start, size = z.place("indexes/index.txt")
                    lines = z.read(start, size).decode().splitlines()
                    data, _ = z.place("archive/data.warc.gz")
                at, n = (list(map(int, x)) for x in zip(*(li.split(" ", 2)[:2] for li in lines)))
                for k in range(0, len(at), run):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([[data + x for x in at[k:k + run]]], pa.list_(pa.int64())),
                         pa.array([n[k:k + run]], pa.list_(pa.int64()))], ["path", "starts", "sizes"])

    def read(batches):
        for b in batches:
            for path, starts, sizes in zip(*(c.to_pylist() for c in b.columns)):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as f:
                    rows, held = [], 0
                    for at, n in zip(starts, sizes):
                        f.seek(at)
                        head, body = parse_record(zlib.decompress(f.read(n), 31))
                        own = head["warc-type"] == "response"
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if own and sha1_base32(body) != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                        rows.append((_bare(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"],
                                     len(body) if own else int(head["x-payload-length"]), digest,
                                     _bare(head.get("warc-refers-to")), body.decode() if own else None))
                        held += len(body)
                        if held > 8_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    runs = packages.select("path").mapInArrow(index, "path string, starts array<long>, sizes array<long>")
    # a run is a few numbers a record: this moves no payload
    parts = packages.sparkSession.sparkContext.defaultParallelism
    found = runs.repartition(parts).mapInArrow(read, _RECORD)
    ids = [F.nullif(F.col(c), F.lit("")).cast(id_type).alias(c) for c in ("id", "refers_to")]
    return found.select(ids[0], "uri", "record_type", "payload_bytes", "payload_digest", ids[1], "payload")


_NAMES = ["id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
_RECORD = ("id string, uri string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to string, payload string")


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from widen.session import checkpoint_dir

    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    packages = write_packages(pages, folder).checkpoint()
    return read_packages(packages, folder).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLES = {"op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM p),
h AS (SELECT *, unhex(sha1(html)) AS d FROM f),
bits AS (
  SELECT page_id, html, first,
         list_reduce(list_transform(range(20), lambda i: lpad(bin(('0x' || substr(hex(d), 2 * i + 1, 2))::INT), 8, '0')),
                     lambda a, b: a || b) AS b
  FROM h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                list_reduce(list_transform(range(5), lambda k: substr(b, 5 * i + k + 1, 1)::INT * (1 << (4 - k))::INT),
                            lambda x, y: x + y)::INT + 1, 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""}
