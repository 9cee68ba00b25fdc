"""Legacy web archives (ARC versions 1 and 2) and their conversion to WARC.

A version's header line names its fields, which are read from the right, as only the URL can hold blanks; the declared length
says where a record ends. From these the converter makes WARC records: identifiers from the record's place in its file,
timestamps from the 14 digits, types from the block (a response has an HTTP header), and SHA-1 payload digests in base32. Of records with equal payloads of at
least `min_bytes`, the one with the largest key stays a response and the others become revisits of it.

Archives are written by Spark's text writer (gzip) into files of a bounded number of records and, but for one record, of bytes,
each file with its own first record: a file is one row of the writer. They are read with Spark's binaryFile reader, so any store that Spark reaches will do. The list of
repeated digests is made of digests and keys alone, and broadcast while it has at most `broadcast_rows` rows: no payload is shuffled
then. Beyond that it is joined by a shuffle on the digest, which moves the payloads too.

Nulls: a null payload is empty, a null URL gets a urn, a null key counts as the smallest. Rows that repeat with their key are
all responses where that key is the largest. Records of other writers have no key; lengths of revisits are kept in a header
field of the record, else taken from its HTTP header, else unknown (null). Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, written

# The field lines of both ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP_TYPE = "application/http; msgtype=response"


@dataclass(frozen=True)
class ArchiveRules:
    """min_bytes: least payload of a revisit; per_file, file_bytes: records and bytes in a file, before compression; date: of records without one; broadcast_rows: see
    the module."""

    min_bytes: int = 0
    per_file: int = 4000
    file_bytes: int = 64_000_000
    date: str = "20200101000000"
    broadcast_rows: int = 200_000


# --- ARC ---------------------------------------------------------------------------------------------------------------


def arc_first(version: int, name: str, date: str) -> bytes:
    """The version block that starts an ARC file."""
    body = f"{version} 0 leakscan\n{FIELDS[version]}\n".encode()
    tail = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{tail} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, name: str = "-") -> bytes:
    tail = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {mime}{tail} {len(block)}\n".encode() + block


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record after the version block; the version comes from that block's first line."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    head = data[end + 1 : end + 1 + length].split(b"\n")
    version = int(head[0].split()[0])
    if version not in FIELDS:
        raise ValueError(f"ARC version {version}")
    names = FIELDS[version].split()
    at = end + 1 + length
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        fields = dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True))
        length = int(fields["Archive-length"])
        yield at, fields, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def iso_date(date: str, default: str) -> str:
    d = re.sub(r"\D", "", date)
    d = (d + default[len(d) :])[:14] if len(d) >= 4 else default
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP response's header (with its empty line) and payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block, b"") if not m else (block[: m.end()], block[m.end() :])


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing and reading with Spark ---------------------------------------------------------------------------------------


class _FileRows:
    """Gathers records into rows that are whole files; first makes a file's first record."""

    def __init__(self, first: Callable[[int], bytes], between: bytes, rules: ArchiveRules) -> None:
        self.first, self.between, self.rules, self.files = first, between, rules, 0
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        if self.parts and (len(self.parts) > self.rules.per_file or self.size + len(record) > self.rules.file_bytes):
            yield self.row()
        if not self.parts:
            self.parts, self.size = [self.first(self.files)], 0
        self.parts.append(record)
        self.size += len(record)

    def row(self) -> pa.RecordBatch:
        out = pa.array([self.between.join(self.parts)], pa.binary())
        self.parts, self.files = [], self.files + 1
        return pa.RecordBatch.from_arrays([out], names=["record"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield self.row()


def _write(files: DataFrame, path: str, line_sep: str) -> None:
    files.select(F.col("record").cast("string")).write.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "lineSep": line_sep, "maxRecordsPerFile": "1"}).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, rules: ArchiveRules = ArchiveRules()) -> None:
    """Writes pages (key, url, payload) as ARC files; files take turns in the two versions."""

    def to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = lambda file: 1 + file % 2
        rows = _FileRows(lambda file: arc_first(version(file), "pages.arc", rules.date), b"\n", rules)
        for b in batches:
            for key, url, payload in zip(*(b[c] for c in ("key", "url", "payload")), strict=True):
                key, payload = key.as_py(), payload.as_py() or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + ("" if key is None else f"X-Key: {key}\r\n") + "\r\n"
                url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url.as_py() or "") or f"urn:page:{key}"
                block = head.encode() + payload
                if rows.parts and (len(rows.parts) > rules.per_file or rows.size + len(block) > rules.file_bytes):
                    yield rows.row()  # the record is written in the next file's version
                yield from rows.add(arc_record(version(rows.files), url, rules.date, "text/html", block))
        yield from rows.rest()

    _write(pages.select("key", "url", F.col("payload").cast("binary").alias("payload")).mapInArrow(to_arc, "record binary"), path, "\n")


def read_arc(spark: SparkSession, path: str, rules: ArchiveRules = ArchiveRules(), blocks: bool = True) -> DataFrame:
    """Records of ARC files with what WARC needs: record_id, type, uri, ip, date, mime, key, digest, size and, with blocks,
    header and payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for at, f, block in arc_records(data) if data else ():
                    header, payload = http_parts(block)
                    m = re.search(rb"\r\nX-Key: (-?\d+)\r\n", header)
                    kind = "response" if header else "resource"
                    row = (f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}')}", kind, f["URL"], f["IP-address"], iso_date(f["Archive-date"], rules.date), f["Content-type"], int(m[1]) if m else None, digest32(payload), len(payload))
                    rows.append((*row, header, payload) if blocks else row)
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], names=schema.names)

    schema = pa.schema([(n, pa.string()) for n in ("record_id", "type", "uri", "ip", "date", "mime")] + [("key", pa.int64()), ("digest", pa.string()), ("size", pa.int64())] + [("header", pa.binary()), ("payload", pa.binary())] * blocks)
    ddl = "record_id string, type string, uri string, ip string, date string, mime string, key bigint, digest string, size bigint" + ", header binary, payload binary" * blocks
    return _files(spark, path).mapInArrow(parse, ddl)


def revisit_targets(meta: DataFrame, rules: ArchiveRules) -> DataFrame:
    """Of each digest that several records have: the record with the largest key."""
    top = F.max(F.struct(F.col("key").alias("key"), F.col("record_id").alias("record_id"), F.col("uri").alias("uri"), F.col("date").alias("date")))
    return (
        meta.where((F.col("size") >= rules.min_bytes) & (F.col("type") == "response")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), top.alias("top"))
        .where("n > 1").select("digest", "top")
    )


def warc_bytes(kind: str, record_id: str, date: str, headers: list[tuple[str, str | None]], mime: str, block: bytes) -> bytes:
    """A WARC record without the two line ends that follow it."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *headers, ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n" + block


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, rules: ArchiveRules = ArchiveRules()) -> None:
    """Converts all ARC files under arc_path to WARC files under warc_path."""
    # digests, keys and identifiers of repeated payloads, from one parse of the archives
    targets = written(revisit_targets(read_arc(spark, arc_path, rules, blocks=False), rules), "targets")
    if targets.limit(rules.broadcast_rows + 1).count() <= rules.broadcast_rows:
        targets = F.broadcast(targets)
    records = read_arc(spark, arc_path, rules).join(targets, "digest", "left")

    def to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def first(file: int) -> bytes:
            info = b"software: leakscan\r\nformat: WARC File Format 1.0\r\n"
            return warc_bytes("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, now['record_id'])}", now["date"], [], "application/warc-fields", info)

        rows, now = _FileRows(first, b"\r\n\r\n", rules), {}
        for b in batches:
            for i in range(len(b)):
                r = {c: b[c][i].as_py() for c in b.schema.names}
                now.update(record_id=r["record_id"], date=r["date"])
                top = r["top"]
                known = [("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha1:{r['digest']}")]
                large = r["type"] == "response" and r["size"] >= rules.min_bytes
                if top is not None and large and r["key"] != top["key"]:
                    known += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{top['record_id']}>"), ("WARC-Refers-To-Target-URI", top["uri"]), ("WARC-Refers-To-Date", top["date"]), ("X-Payload-Length", str(r["size"]))]
                    record = warc_bytes("revisit", r["record_id"], r["date"], known, HTTP_TYPE, r["header"])
                else:
                    record = warc_bytes(r["type"], r["record_id"], r["date"], known, HTTP_TYPE if r["header"] else r["mime"], r["header"] + r["payload"])
                yield from rows.add(record)
        yield from rows.rest()

    _write(records.mapInArrow(to_warc, "record binary"), warc_path, "\r\n\r\n")


class Headers(dict):
    """Named fields in any case and spacing, folded lines joined; of repeated names the first counts."""

    def __init__(self, lines: list[str]) -> None:
        super().__init__()
        name = None
        for line in lines:
            if line[:1] in (" ", "\t") and name:
                self[name] = f"{self[name]} {line.strip()}"
            elif ":" in line:
                name, value = (x.strip() for x in line.split(":", 1))
                name = None if name.lower() in self else name.lower()
                if name:
                    self[name] = value

    def __missing__(self, name: str) -> str:
        low = name.lower()
        if low == name:
            raise KeyError(name)
        return self[low]

    def field(self, name: str, default: str | None = None) -> str | None:
        return self.get(name.lower(), default)


def warc_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError(f"a record's header at byte {at} has no end")
            return
        headers = Headers(data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        told = headers.field("Content-Length")
        if told is None or not told.isdecimal():
            raise ValueError(f"the record at byte {at} declares no length")
        yield headers, data[end + 4 : end + 4 + int(told)]
        at = end + 4 + int(told)
        while data[at : at + 2] == b"\r\n":  # two, by the standard
            at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: record_id, record_type, uri, key, payload_bytes, payload_digest, refers_id (of revisits). The
    digest of a response is that of the payload as read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                data = content.as_py()
                rows = []
                for h, block in warc_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, record_id = h.field("WARC-Type", ""), (h.field("WARC-Record-ID") or "").strip("<>")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    header, payload = http_parts(block)
                    m = re.search(rb"\r\nX-Key: (-?\d+)\r\n", header)
                    size, digest = len(payload), digest32(payload)
                    stated = (h.field("WARC-Payload-Digest") or "").removeprefix("sha1:")
                    if kind == "revisit":
                        told = h.field("X-Payload-Length") or ((c := re.search(rb"(?i)\r?\ncontent-length:[ \t]*(\d+)", header)) and c[1])
                        size, digest = None if told is None else int(told), stated
                    elif stated and re.fullmatch("[A-Z2-7]{32}", stated) and digest != stated:
                        raise ValueError(f"payload of {record_id} differs from its digest")
                    rows.append((record_id, kind, (h.field("WARC-Target-URI") or "").strip("<>"), int(m[1]) if m else None, size, digest, (h.field("WARC-Refers-To") or "").strip("<>") or None))
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = ["record_id", "record_type", "uri", "key", "payload_bytes", "payload_digest", "refers_id"]
    types = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] * 2
    return _files(spark, path).mapInArrow(parse, "record_id string, record_type string, uri string, key bigint, payload_bytes bigint, payload_digest string, refers_id string")


def archive_round_trip(pages: DataFrame, rules: ArchiveRules = ArchiveRules()) -> DataFrame:
    """pages (page_id, url, html) through ARC files and their WARC conversion and back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages.select(F.col("page_id").cast("long").alias("key"), "url", F.col("html").alias("payload")), arc, rules)
    convert_arc(spark, arc, warc, rules)
    records = written(read_warc(spark, warc), "warc-records")  # small: no payloads
    keep = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    named = records.withColumnRenamed("key", "page_id")
    targets = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_to"))
    revisits = named.where("record_type = 'revisit'").select(*keep, "refers_id").join(targets, "refers_id").select(*keep, "refers_to")
    return named.where("record_type <> 'revisit'").select(*keep, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
