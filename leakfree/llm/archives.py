"""Legacy archive converter: ARC files, version 1 and 2, to WARC files.

An ARC file opens with a version block: a ``filedesc`` record line, the line with its version, and the line
that names the fields of the record lines that follow. Every record is a line of these fields, of which the
last is the length of the block behind it. The converter makes a WARC record of each: an identifier from the
archive's name and the record's offset, the ISO form of the 14-digit (or shorter) time, the type from
the scheme of the address, and SHA-1 digests of the block and of the HTTP payload.

Archives are sequences of gzip members, one per record, and are written by Spark's text sink, so that they reach
any file system Spark can write: the value is a member without its last byte, which is zero for every
member that ends in an empty one, and the line separator is that zero byte. They are read as binary files.
One file is what one task writes, and one task reads a whole file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stored

# The field lines of the two versions, and the name space of identifiers made from names.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.NAMESPACE_URL
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_FIELD = "X-Source-Key"
"""HTTP header and WARC field that carry the key of the row a record was made of."""

_EMPTY_MEMBER = gzip.compress(b"", 1, mtime=0)
_CHUNK = 1 << 16


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that ends in a zero byte, that byte cut off."""
    packed = gzip.compress(data, level, mtime=0)
    if packed[-1]:
        packed += _EMPTY_MEMBER
    return packed[:-1]


class Members:
    """Reads bytes and lines from a sequence of gzip members; holds what one read asks for and a chunk."""

    def __init__(self, data: bytes):
        self.data, self.at, self.offset = memoryview(data), 0, 0
        self.open = zlib.decompressobj(31)
        self.held = bytearray()

    def _more(self) -> bool:
        while True:
            if self.open.eof:
                self.at -= len(self.open.unused_data)
                self.open = zlib.decompressobj(31)
            tail = self.open.unconsumed_tail
            chunk = tail or self.data[self.at:self.at + _CHUNK]
            if not tail:
                self.at += len(chunk)
            found = self.open.decompress(chunk, 4 * _CHUNK)
            self.held += found
            if found:
                return True
            if not len(chunk):
                return False

    def read(self, n: int) -> bytes:
        """Up to ``n`` bytes, fewer at the end."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.offset += len(out)
        return out

    def line(self) -> bytes:
        """The next line without its end; empty at the end."""
        start = 0
        while (end := self.held.find(b"\n", start)) < 0:
            start = len(self.held)
            if not self._more():
                return self.read(len(self.held)).rstrip(b"\r")
        return self.read(end + 1)[:-1].rstrip(b"\r")

    def ended(self) -> bool:
        return not self.held and not self._more()


@dataclass
class ArcRecord:
    archive: str
    offset: int
    fields: dict[str, str]
    block: bytes
    declared: int


def arc_head(name: str, version: int, date: str) -> bytes:
    """The version block of an ARC file."""
    body = f"{version} 0 {name}\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(name: str, version: int, url: str, date: str, block: bytes, offset: int = 0, code: str = "200") -> bytes:
    """An ARC record, without the line end that parts it from the next."""
    extra = "" if version == 1 else f" {code} - - {offset} {name}"
    return f"{url} 0.0.0.0 {date} text/html{extra} {len(block)}\n".encode() + block


def read_arc(data: bytes, path: str = "") -> Iterator[ArcRecord]:
    """The records of an ARC file (a sequence of gzip members) after its version block.

    The field line of the version block says how record lines are read. A record shorter than declared, at
    the end of a cut file, comes with what there is of it. A line that does not fit raises ValueError.
    """
    source = Members(data)
    if source.ended():
        return
    head = source.line().decode("utf-8", "replace").split(" ")
    if not head[0].startswith("filedesc://") or not head[-1].isdigit():
        raise ValueError(f"{path}: no version block")
    archive = head[0].removeprefix("filedesc://")
    body = source.read(int(head[-1])).decode("utf-8", "replace").splitlines()
    if len(body) < 2 or body[0].split(" ")[0] not in ("1", "2"):
        raise ValueError(f"{path}: unknown version {body[:1]}")
    names = body[1].split(" ")
    while not source.ended():
        offset = source.offset
        line = source.line()
        if not line:
            continue
        values = line.decode("utf-8", "replace").split(" ")
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"{path}: bad record line at {offset}")
        declared = int(values[-1])
        yield ArcRecord(archive, offset, dict(zip(names, values, strict=True)), source.read(declared), declared)


def iso_time(date: str) -> str:
    """YYYYMMDDhhmmss, or a prefix of it, as ISO 8601."""
    digits = (date + "00000101000000"[len(date):])[:14] if len(date) >= 4 else "19700101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_kind(url: str) -> str:
    """The WARC type of an ARC record by the scheme of its address."""
    scheme = url.partition(":")[0].lower()
    return {"http": "response", "https": "response", "filedesc": "warcinfo"}.get(scheme, "resource")


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields in lower case, the header with its blank line, and the payload of an HTTP block."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return {}, b"", block
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, block[:end + 4], block[end + 4:]


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{WARC_VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of every record of a WARC file (a sequence of gzip members)."""
    source = Members(data)
    while not source.ended():
        line = source.line()
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while line := source.line():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = source.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("cut WARC record")
        yield fields, block


def _write(rows: DataFrame, path: str) -> str:
    """Writes the column ``member`` as archive files."""
    rows.select(F.col("member").cast("string")).write.option("lineSep", "\x00").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


_MEMBER = pa.schema([("member", pa.binary())])


def write_arc(pages: DataFrame, path: str, date: str = "20000101000000", key: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Writes ARC files of an HTTP record per row, one file per partition, versions 1 and 2 in turn."""
    rows = pages.select(F.spark_partition_id().alias("p"), F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, version, offset = "", 1, 0
        for batch in batches:
            out, size = [], 0
            for p, k, u, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                if not name:
                    version, name = 1 + p.as_py() % 2, f"part-{p.as_py():06d}.arc"
                    head = arc_head(name, version, date)
                    out.append(member(head))
                    offset += len(head)
                data = data.as_py() or b""
                own = "" if k.as_py() is None else f"{KEY_FIELD}: {k.as_py()}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(data)}\r\n\r\n".encode() + data
                address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u.as_py() or "") or "http://unknown.invalid/"
                record = b"\n" + arc_record(name, version, address, date, http, offset + 1)
                offset += len(record)
                out.append(member(record))
                size += len(out[-1])
                if size > 1 << 23:
                    yield pa.record_batch([pa.array(out, pa.binary())], schema=_MEMBER)
                    out, size = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], schema=_MEMBER)

    return _write(rows.mapInArrow(run, "member binary"), path)


_ARC = pa.schema([
    ("id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("time", pa.string()), ("mime", pa.string()),
    ("truncated", pa.bool_()), ("key", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
_ARC_SQL = "id string, kind string, url string, ip string, time string, mime string, truncated boolean, key long, digest string, block binary"


def read_arcs(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """A row per ARC record with the WARC values made from it; ``digest`` is that of the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for r in read_arc(data.as_buffer(), where.as_py()):
                    address = r.fields["URL"]
                    kind = record_kind(address)
                    http, _, payload = http_parts(r.block) if kind == "response" else ({}, b"", r.block)
                    own = http.get(KEY_FIELD.lower(), "")
                    rows.append({
                        "id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{r.archive}:{r.offset}')}>", "kind": kind, "url": address,
                        "ip": r.fields.get("IP-address", ""), "time": iso_time(r.fields.get("Archive-date", "")),
                        "mime": r.fields.get("Content-type", ""), "truncated": len(r.block) < r.declared,
                        "key": int(own) if own.lstrip("-").isdigit() else None, "digest": sha1_32(payload),
                        "block": r.block if blocks else None})
                    size += len(r.block)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARC)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_ARC)

    return _files(spark, path).mapInArrow(run, _ARC_SQL)


def convert(spark: SparkSession, arcs: str, path: str, min_bytes: int = 0) -> str:
    """Writes the WARC files of the ARC files in ``arcs``.

    Of responses with equal payloads of at least ``min_bytes`` bytes the one with the largest key (then the
    largest identifier) keeps its payload, the others become revisits that hold the HTTP header alone. The
    leaders of payloads that occur more than once are found by an aggregation over digests; the join
    with them may be split or broadcast by the planner, so that a frequent payload falls into no one task.
    """
    heads = read_arcs(spark, arcs, blocks=False).where("kind = 'response'")
    order = F.struct(F.col("key"), F.col("id"), F.col("url"), F.col("time"))
    leaders = stored(heads.groupBy("digest").agg(F.max(order).alias("leader"), F.count("*").alias("n")).where("n > 1").select(
        "digest", F.col("leader.id").alias("leader_id"), F.col("leader.key").alias("leader_key"),
        F.col("leader.url").alias("leader_url"), F.col("leader.time").alias("leader_time")), "leaders")
    joined = read_arcs(spark, arcs).join(leaders, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                out.append(member(_converted(r, min_bytes)))
                size += len(out[-1])
                if size > 1 << 23:
                    yield pa.record_batch([pa.array(out, pa.binary())], schema=_MEMBER)
                    out, size = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], schema=_MEMBER)

    return _write(joined.mapInArrow(run, "member binary"), path)


def _converted(r: dict, min_bytes: int) -> bytes:
    """One WARC record from a row of :func:`read_arcs` joined with its payload's leader."""
    kind, block = r["kind"], r["block"]
    header, payload = http_parts(block)[1:] if kind == "response" else (b"", block)
    if kind == "response" and r["leader_id"] not in (None, r["id"]) and len(payload) >= min_bytes:
        kind = "revisit"
    mime = "application/http;msgtype=response" if kind in ("response", "revisit") else r["mime"]
    fields = [("WARC-Type", kind), ("WARC-Record-ID", r["id"]), ("WARC-Date", r["time"]), ("WARC-Target-URI", r["url"]),
              ("WARC-IP-Address", r["ip"]), ("Content-Type", mime), ("WARC-Payload-Digest", f"sha1:{r['digest']}")]
    if r["key"] is not None:
        fields.append((KEY_FIELD, str(r["key"])))
    if r["truncated"]:
        fields.append(("WARC-Truncated", "length"))
    if kind == "revisit":
        block = header
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", r["leader_id"]),
                   ("WARC-Refers-To-Target-URI", r["leader_url"]), ("WARC-Refers-To-Date", r["leader_time"])]
        if r["leader_key"] is not None:
            fields.append((f"{KEY_FIELD}-Referred", str(r["leader_key"])))
    return warc_record([*fields, ("WARC-Block-Digest", f"sha1:{sha1_32(block)}")], block)


_WARC = pa.schema([
    ("id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("time", pa.string()), ("key", pa.int64()), ("referred", pa.int64()),
    ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_WARC_SQL = "id string, type string, url string, time string, key long, referred long, refers_to_id string, payload_bytes long, payload_digest string, payload binary"


def _read_back(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = fields["warc-type"]
    if f"sha1:{sha1_32(block)}" != fields["warc-block-digest"]:
        raise ValueError("a block does not have its digest")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    http, _, payload = http_parts(block) if kind in ("response", "revisit") else ({}, b"", block)
    if kind == "revisit":
        size, payload = int(http["content-length"]), None
    else:
        size = len(payload)
        if sha1_32(payload) != digest:
            raise ValueError("a payload does not have its digest")
    own, referred = fields.get(KEY_FIELD.lower()), fields.get(f"{KEY_FIELD}-Referred".lower())
    return {"id": fields["warc-record-id"], "type": kind, "url": fields["warc-target-uri"], "time": fields["warc-date"],
            "key": None if own is None else int(own), "referred": None if referred is None else int(referred),
            "refers_to_id": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if payloads else None}


def read_warcs(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per WARC record; digests are checked. A revisit has the size and digest of its full payload, not its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                rows, size = [], 0
                for fields, block in read_warc(data.as_buffer()):
                    rows.append(_read_back(fields, block, payloads))
                    size += len(block)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema=_WARC)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_WARC)

    return _files(spark, path).mapInArrow(run, _WARC_SQL)


def op1_warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the converted archive of all pages.

    A null html is an empty payload, a null url a placeholder. Rows without page_id are records without a key;
    they are the smallest of their payload. Rows that repeat a page_id and a payload are separate
    records of which one is the response. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    arcs = write_arc(pages, scratch_path(spark, "arc"))
    records = read_warcs(spark, convert(spark, arcs, scratch_path(spark, "warc")), payloads=False)
    return records.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("referred").alias("refers_to"))
