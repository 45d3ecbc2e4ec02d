"""Legacy archive converter: ARC 1 and 2 to WARC 1.1, and the reading of the WARC files written.

An ARC archive starts with a version block (a filedesc line, the version line, a line that names the header fields);
each further record is a header line of those fields and as many bytes as its last field declares. The converter
synthesises what ARC lacks: record ids (from archive, offset and URL, so reruns agree), ISO timestamps, record types,
block and payload digests. Records whose payload equals that of another one become revisits of the one with the
smallest key; the key is the HTTP header X-Record-Key.

WARC files are written by Spark's text writer: a record ends with CR LF CR LF, which is its line separator, and files
are gzipped. They are read back record by record from their declared lengths.

Defined results: a null payload or URL counts as empty; payloads shorter than min_bytes are never revisits; rows
repeated with the same key and payload get the same type; records without a key are revisits of the smallest key with
their payload if there is one, else responses; an archive that is cut off or malformed gives its whole records and
then one row with record_type 'error'; an empty table gives no record; columns other than page_id, url and html are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import MAX_BROADCAST_IDS, new_path, write_table
from patchweave.operators.hot_keys import join_counted

V1_FIELDS = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
V2_FIELDS = ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]
ARCHIVE_BYTES = 4 << 20
#: What a WARC file holds at most, in bytes before compression (a larger record has a file of its own), and how many
#: bytes of records are handed to the writer at a time.
FILE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
RECORD_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "20200101000000"

RECORDS = "archive string, offset long, record_key long, url string, ip string, warc_date string, content_type string, record_type string, record_id string, head binary, payload binary, payload_bytes long, payload_digest string, payload_sha256 string"


class ArchiveError(ValueError):
    """The bytes aren't an archive of that format."""


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- ARC ----


def write_arc(name: str, version: int, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC archive of (URL, content type, block) records."""
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    body = f"{version} 0 patchweave\n{' '.join(fields)}\n\n".encode()
    out = io.BytesIO()

    def header(url: str, kind: str, block: bytes) -> bytes:
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "about:blank"
        more = [] if version == 1 else ["200", "-", "-", str(out.tell()), name]
        return (" ".join([url, "0.0.0.0", CAPTURED, kind, *more, str(len(block))]) + "\n").encode()

    out.write(header(f"filedesc://{name}", "text/plain", body) + body)
    for url, kind, block in records:
        out.write(b"\n" + header(url, kind, block) + block)
    return out.getvalue()


def read_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record, the version block first."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"no header line at {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            if not line[0].startswith("filedesc:"):
                raise ArchiveError("no version block")
            length = _declared(line[-1], at)
            block = data[end + 1 : end + 1 + length]
            lines = block.decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0] if lines else ""
            if version not in ("1", "2"):
                raise ArchiveError(f"unknown version {version!r}")
            fields = lines[1].split(" ") if len(lines) > 1 and lines[1].strip() else (V1_FIELDS if version == "1" else V2_FIELDS)
        if len(line) < len(fields):
            raise ArchiveError(f"{len(line)} of {len(fields)} header fields at {at}")
        # A content type or URL with spaces makes the line longer; the fields after the URL are taken from the right.
        extra = len(line) - len(fields)
        values = [" ".join(line[: extra + 1]), *line[extra + 1 :]]
        length = _declared(values[-1], at)
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ArchiveError(f"{len(block)} of {length} bytes at {at}")
        yield at, dict(zip(fields, values, strict=True)), block
        at = end + 1 + length


def _declared(text: str, at: int) -> int:
    if not text.isascii() or not text.isdigit():
        raise ArchiveError(f"bad length {text!r} at {at}")
    return int(text)


def iso_date(stamp: str) -> str:
    """ARC's 8, 12 or 14 digits as WARC writes them; the epoch if there are none."""
    digits = stamp if stamp.isascii() and stamp.isdigit() and len(stamp) in (8, 12, 14) else "19700101"
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _convert(archive: str, data: bytes) -> Iterator[tuple]:
    try:
        for offset, f, block in read_arc(data):
            url, kind = f["URL"], f.get("Content-type", "application/octet-stream")
            head, payload, key = b"", block, None
            if url.startswith("filedesc:"):
                record_type = "warcinfo"
            elif block.startswith(b"HTTP/"):
                record_type = "response"
                end = re.search(rb"\r?\n\r?\n", block)
                cut = end.end() if end else len(block)
                head, payload = block[:cut], block[cut:]
                if m := re.search(rb"(?im)^X-Record-Key:[ \t]*(-?\d+)[ \t]*\r?$", head):
                    key = int(m[1])
            else:
                record_type = "resource"
            name = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{offset} {url}")
            yield archive, offset, key, url, f.get("IP-address"), iso_date(f.get("Archive-date", "")), kind, record_type, f"<urn:uuid:{name}>", head, payload, len(payload), b32_sha1(payload), hashlib.sha256(payload).hexdigest()
    except ArchiveError as e:
        yield archive, None, None, str(e), None, None, None, "error", None, b"", b"", 0, None, None


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of some MB, so that one with large rows stays small."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (bytes, str)))
        if size > limit or len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_RECORD_TYPES = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]
_RECORD_SCHEMA = pa.schema([(c.split()[0], t) for c, t in zip(RECORDS.split(", "), _RECORD_TYPES, strict=True)])


def arc_to_records(archives: DataFrame) -> DataFrame:
    """The records of ARC archives (archive string, content binary), with all that WARC asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for b in batches for a, c in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True) for r in _convert(a, c or b"")), _RECORD_SCHEMA)

    return archives.select("archive", "content").mapInArrow(run, RECORDS)


def with_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to (a key) and makes revisits of responses that repeat a payload. records: a written table."""
    responses = records.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    # Equal payloads fold before the shuffle; keys and digests only are compared.
    first = responses.groupBy("payload_sha256", "payload_bytes").agg(F.min("record_key").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    slim = responses.select("payload_sha256", "payload_bytes", "record_key")
    revisits = join_counted(slim, first, ["payload_sha256", "payload_bytes"], "n", slim.count()).filter(~F.col("record_key").eqNullSafe(F.col("refers_to")))
    revisits = write_table(revisits.select(F.col("record_key").alias("__key"), F.col("payload_sha256").alias("__sha"), "refers_to").distinct(), "op5-revisits")
    if revisits.count() <= MAX_BROADCAST_IDS // 8:
        revisits = F.broadcast(revisits)
    out = records.join(revisits, records.record_key.eqNullSafe(F.col("__key")) & (F.col("payload_sha256") == F.col("__sha")) & (F.col("record_type") == "response"), "left")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise(F.col("record_type"))).drop("__key", "__sha")


# ---- WARC ----


def warc_record(r: dict) -> bytes:
    """A record without the closing CR LF CR LF."""
    kind = r["record_type"]
    block = r["head"] if kind == "revisit" else r["head"] + r["payload"]
    content = {"response": "application/http;msgtype=response", "revisit": "application/http;msgtype=response", "warcinfo": "application/warc-fields"}.get(kind, r["content_type"])
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['warc_date']}"]
    lines += [f"WARC-Filename: {r['url'].removeprefix('filedesc://')}"] if kind == "warcinfo" else [f"WARC-Target-URI: {r['url']}"]
    if r["ip"] and r["ip"] != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {r['ip']}")
    if kind in ("response", "revisit"):
        lines += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"X-Payload-Length: {r['payload_bytes']}"]
        if r["record_key"] is not None:
            lines.append(f"X-Record-Key: {r['record_key']}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {r['refers_to']}"]
    lines += [f"WARC-Block-Digest: sha1:{b32_sha1(block)}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the records, errors left out, as gzipped WARC files under path. Records go to the writer in chunks of
    CHUNK_BYTES, a larger one by itself, so that one large record makes files of a chunk, not of a record."""
    schema = pa.schema([("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                record = warc_record(b.slice(i, 1).to_pylist()[0])
                if held and size + len(record) > CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([RECORD_END.join(held)], pa.binary())], schema=schema)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([RECORD_END.join(held)], pa.binary())], schema=schema)

    largest = records.agg(F.max("payload_bytes")).first()[0] or 0
    per_file = max(1, FILE_BYTES // max(CHUNK_BYTES, largest + 2_000))
    lines = records.filter("record_type <> 'error'").drop("payload_sha256", "archive", "offset").mapInArrow(run, "record binary")
    lines.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record; a broken file raises ArchiveError."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"{line[:40]!r} where a record is due")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        length = _declared(fields.get("content-length", ""), 0)
        block = stream.read(length)
        if len(block) < length:
            raise ArchiveError(f"{len(block)} of {length} bytes")
        yield fields, block


READ = "record_key long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, intact boolean"
_READ_SCHEMA = pa.schema([("record_key", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def _read(content: bytes) -> Iterator[tuple]:
    whole = lambda x: int(x) if x is not None else None
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    for f, block in parse_warc(stream):
        kind, digest = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        intact, size = f.get("warc-block-digest") == f"sha1:{b32_sha1(block)}", whole(f.get("x-payload-length"))
        if kind == "response":  # the payload itself is measured; a revisit has its figures only
            end = re.search(rb"\r?\n\r?\n", block)
            payload = block[end.end() :] if end else b""
            size, digest, intact = len(payload), b32_sha1(payload), intact and digest == b32_sha1(payload)
        yield whole(f.get("x-record-key")), kind, f.get("warc-target-uri"), size, digest, whole(f.get("x-refers-to-key")), intact


def read_warc(spark, path: str) -> DataFrame:
    """A row per record of the WARC files under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for b in batches for i in range(b.num_rows) for r in _read(b.column("content")[i].as_py())), _READ_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


# ---- the query ----


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """pages as ARC archives, version 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size, part = 0, [], 0, TaskContext.get().partitionId()
        schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

        def archive() -> pa.RecordBatch:
            name = f"{hashlib.sha1(repr([(u, len(b)) for u, _, b in held]).encode()).hexdigest()[:12]}-{part}-{n}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_arc(name, 1 + n % 2, held)], pa.binary())], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                key, url, html = (b.column(k)[i].as_py() for k in range(3))
                payload = (html or "").encode()
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Record-Key: {key}\r\n" if key is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
                held.append((url or "", "text/html", head.encode() + payload))
                size += len(payload) + 400
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    n, held, size = n + 1, [], 0
        if held:
            yield archive()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "archive string, content binary")


def op5_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = write_table(arc_to_records(pages_to_arc(pages)), "op5-records")
    path = new_path(spark, "op5-warc")
    write_warc(with_revisits(records), path)
    found = read_warc(spark, path).filter("record_type in ('response', 'revisit')")
    return found.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first,
    list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
      lambda s: substr('{_ALPHABET}', CAST(1 + (((('0x' || substr(h, CAST(1 + 5 * i AS INT), 5))::BIGINT) >> s) & 31) AS INT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
