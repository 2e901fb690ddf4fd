"""WARC archives as a PySpark Python data source (``format("warc")``), and de-duplicating page archives.

Files hold one gzip member per record with the skip lengths of the WARC standard's annex in its extra field
(``sl``: compressed and uncompressed length), so a reader that does not want a record seeks over it; members
without the field are inflated to find their end. Plain ``.warc`` files are read as well.

Writing: a task writes files of at most ``maxFileBytes`` under names of their own; the driver's commit lists the
files of the successful attempts in ``_files.json``. Reading: files are packed into partitions of about
``partitionBytes``; equality, ``IN``, prefix and null tests on ``type``, ``record_id``, ``target_uri``,
``payload_digest`` and ``refers_to`` are pushed down. A reader inflates only a record's header block, applies the
pushed tests, and inflates the payload only of records that pass, and only if ``payload`` is wanted (option
``payload``, default true).

Paths are opened with ``pyarrow.fs`` (local, HDFS, object stores).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    IsNotNull, IsNull, StringStartsWith, WriterCommitMessage)

from presswork.llm.common import open_path
from presswork.session import scratch_path

SCHEMA = ("record_id string, type string, target_uri string, date string, payload_digest string, "
          "payload_bytes long, refers_to string, payload binary")
HEADERS = ["record_id", "type", "target_uri", "payload_digest", "refers_to"]
MANIFEST = "_files.json"
# Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header field with the length of the full payload; the standard leaves extra fields to the writer.
LENGTH_FIELD = "X-Payload-Length"
CRLF = b"\r\n"
HEAD_CHUNK = 4096


def _clean(value: str) -> str:
    """A header value: line breaks and other controls as percent escapes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    if row["type"] == "response":
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        block, kind = http + payload, "application/http; msgtype=response"
    else:
        block, kind = b"", None
    fields = [("WARC-Type", row["type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"] or date)]
    if row["target_uri"] is not None:
        fields.append(("WARC-Target-URI", _clean(row["target_uri"])))
    fields.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    if row["type"] == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    if kind:
        fields.append(("Content-Type", kind))
    fields += [(LENGTH_FIELD, str(row["payload_bytes"])), ("Content-Length", str(len(block)))]
    head = CRLF.join([VERSION] + [f"{k}: {v}".encode() for k, v in fields])
    return head + CRLF + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member that tells its compressed and uncompressed length in the ``sl`` extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head_len = 10 + 2 + 12
    extra = struct.pack("<2sHII", b"sl", 8, head_len + len(body) + 8, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + struct.pack("<I", 0) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_head(raw: bytes) -> tuple[int, int | None]:
    """Of a gzip member's first bytes: where the deflate stream starts, and the member's length if it tells."""
    if raw[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    flags, at, length = raw[3], 10, None
    if flags & 4:
        (n,) = struct.unpack_from("<H", raw, at)
        field, end = at + 2, at + 2 + n
        while field + 4 <= end:
            name, size = struct.unpack_from("<2sH", raw, field)
            if name == b"sl" and size == 8:
                length = struct.unpack_from("<I", raw, field + 4)[0]
            field += 4 + size
        at = end
    for bit in (8, 16):  # name and comment end in a zero byte
        if flags & bit:
            at = raw.index(b"\0", at) + 1
    return at + 2 * bool(flags & 2), length


def parse_head(head: bytes) -> dict:
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    bare = lambda v: v[1:-1] if v and v[0] == "<" else v
    digest = out.get("warc-payload-digest")
    length = out.get(LENGTH_FIELD.lower())
    return {"record_id": bare(out.get("warc-record-id")), "type": out.get("warc-type"), "target_uri": out.get("warc-target-uri"),
            "date": out.get("warc-date"), "payload_digest": digest.partition(":")[2] if digest else None,
            "payload_bytes": int(length) if length else None, "refers_to": bare(out.get("warc-refers-to")),
            "content_type": out.get("content-type", ""), "content_length": int(out.get("content-length", 0))}


def _payload(row: dict, block: bytes) -> bytes:
    return block.partition(CRLF + CRLF)[2] if row["content_type"].startswith("application/http") else block


def read_records(f, gz: bool, wanted, with_payload: bool):
    """Records of an open file whose header passes ``wanted``; payloads of others are not decoded."""
    pos, size = 0, f.size()
    while pos < size:
        f.seek(pos)
        raw = f.read(HEAD_CHUNK)
        if gz:
            start, length = _member_head(raw)
            inflate = zlib.decompressobj(-15)
            data, fed = b"", raw[start:]
            while b"\r\n\r\n" not in data and fed:
                data += inflate.decompress(fed, HEAD_CHUNK)
                fed = inflate.unconsumed_tail or (b"" if inflate.eof else f.read(HEAD_CHUNK))
            head, _, rest = data.partition(CRLF + CRLF)
            row = parse_head(head)
            keep = wanted(row)
            need = keep and with_payload and row["type"] != "revisit"
            if need or length is None:
                parts = [rest]
                while not inflate.eof:
                    fed = inflate.unconsumed_tail or fed or f.read(1 << 20)
                    if not fed:
                        raise ValueError(f"truncated record at byte {pos}")
                    parts.append(inflate.decompress(fed, 1 << 20))
                    fed = b""
                if length is None:
                    length = f.tell() - pos - len(inflate.unused_data) + 8
                block = b"".join(parts)[: row["content_length"]]
            pos += length
        else:
            while b"\r\n\r\n" not in raw:
                more = f.read(HEAD_CHUNK)
                if not more:
                    raise ValueError(f"truncated record at byte {pos}")
                raw += more
            head = raw.partition(CRLF + CRLF)[0]
            row = parse_head(head)
            keep = wanted(row)
            need = keep and with_payload and row["type"] != "revisit"
            if need:
                f.seek(pos + len(head) + 4)
                block = f.read(row["content_length"])
            pos += len(head) + 4 + row["content_length"] + 4
        if keep:
            row["payload"] = _payload(row, block) if need else None
            yield row


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.max_bytes = int(options.get("maxFileBytes", 64 << 20))
        self.level = int(options.get("level", 1))
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator):
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        names, out, n = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or n >= self.max_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, n = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                n += out.write(gzip_member(record_bytes(row, self.date), self.level))
        if out is not None:
            out.close()
        return WarcFiles(names)

    def commit(self, messages):
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        """Files of failed attempts stay unlisted; the next write of the folder has names of its own."""


class WarcFiles(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class WarcPartition(InputPartition):
    def __init__(self, files):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", 32 << 20))
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            kind = {EqualTo: "eq", In: "in", StringStartsWith: "prefix", IsNull: "null", IsNotNull: "set"}.get(type(f))
            if kind and name in HEADERS:
                self.tests.append((name, kind, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            v = row[name]
            if kind == "null":
                ok = v is None
            elif v is None:
                ok = False
            else:
                ok = {"eq": lambda: v == value, "in": lambda: v in value, "prefix": lambda: v.startswith(value), "set": lambda: True}[kind]()
            if not ok:
                return False
        return True

    def partitions(self):
        fs, root = open_path(self.path)
        info = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        sizes = {f.path: f.size for f in info if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path)}
        if any(f.path == f"{root}/{MANIFEST}" for f in info):
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                sizes = {p: sizes[p] for p in (f"{root}/{n}" for n in json.loads(f.read()))}
        packs: list[WarcPartition] = []
        room = 0
        for path, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            if not packs or room < size:
                packs.append(WarcPartition([]))
                room = self.partition_bytes
            packs[-1].files.append(path)
            room -= size
        return packs or [WarcPartition([])]

    def read(self, partition):
        fs, _ = open_path(self.path)
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
                            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()),
                            ("payload", pa.binary())])
        rows, n = [], 0
        for path in partition.files:
            with fs.open_input_file(path) as f:
                for row in read_records(f, path.endswith(".gz"), self.wanted, self.with_payload):
                    rows.append({k: row[k] for k in schema.names})
                    n += 200 + len(row["payload"] or b"")
                    if n >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, n = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to a session, with filter push-down and small Arrow batches."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.dataSource.register(WarcDataSource)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as bare upper-case base32: each 20 bits of the digest are 4 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


RECORD_URN = "urn:page:"


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """A WARC record per page. Of pages with equal payloads of at least ``min_bytes``, the one with the largest
    key is the response and the others are revisits that refer to it and carry no payload.

    A null payload is empty. Null keys are below all others; repeated rows of the largest key are all responses.
    Only (digest, key) is aggregated; a table of the digests that occur more than once meets the pages again in an
    equi-join that Spark may broadcast or split where one digest is hot.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("target_uri"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = (rows.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("digest").alias("gdigest"))
              .agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    j = rows.join(groups, F.col("digest") == F.col("gdigest"), "left")
    response = F.col("gdigest").isNull() | F.col("key").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit(RECORD_URN), F.coalesce(c.cast("string"), F.lit("")))
    return j.select(urn(F.col("key")).alias("record_id"), F.when(response, "response").otherwise("revisit").alias("type"),
                    "target_uri", F.lit(None).cast("string").alias("date"), base32_sha1(F.col("payload")).alias("payload_digest"),
                    "payload_bytes", F.when(~response, urn(F.col("first"))).alias("refers_to"),
                    F.when(response, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str, **options) -> None:
    register(records.sparkSession)
    records.select("record_id", "type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "payload") \
        .write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def _page_id(urn: Column) -> Column:
    return F.nullif(F.substring(urn, len(RECORD_URN) + 1, 1 << 30), F.lit("")).cast("long")


def digest(pages: DataFrame) -> DataFrame:
    """Write the archive of ``pages`` and return, from the archive read back, page_id, payload_bytes,
    payload_digest, record_type and refers_to. Length and digest of a response are computed from the payload read
    back, those of a revisit come from its header. Extra columns of the pages are not archived."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(page_records(pages), path)
    back = read_warc(spark, path)
    full = F.col("type") == "response"
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    return back.select(
        _page_id(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length(payload).cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, base32_sha1(payload)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), _page_id(F.col("refers_to")).alias("refers_to"))


DIGEST_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
b AS (
  SELECT page_id, payload_bytes, list_reduce(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)))::BIGINT & 31), 1)),
    lambda x, y: x || y) AS payload_digest FROM d),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM g"""
