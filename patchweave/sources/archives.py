"""Zip and tar archives as a data source: members are rows, and partitions are planned from what the archive says of them.

    spark.dataSource.register(archives.Archives)
    spark.read.format("archive").option("members", r".+[.]json").load("/feeds/all.zip")

The driver reads a zip's central directory, or the headers of a plain tar, and no member; it groups members into
partitions of about partitionBytes, and a task reads its members by their byte ranges, a row each. So an archive may be
of any size, and only a member has to fit into memory. A compressed tar (gzip, or zstandard where it is installed) has
no ranges: it is one partition that streams through it.

Columns: path (of the archive), member, size, content, reason. A member that can't be read, or is larger than
maxMemberBytes, has a reason and no content; an archive that can't be read is one row with a reason and no member. A zip's
sizes are what its directory says; a member that unpacks to more is cut off and has a reason.

Paths may name folders or have wildcards (local ones). Local files are opened as files, others through pyarrow's file systems.
"""

from __future__ import annotations

import glob
import io
import os
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceReader, InputPartition

from patchweave.sources.inventory import READ_ERRORS, Unreadable, why

SCHEMA = "path string, member string, size long, content binary, reason string"
PARTITION_BYTES, MAX_MEMBER_BYTES = 64 << 20, 1 << 30
_ARROW = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("reason", pa.string())])


@dataclass
class Member:
    name: str
    size: int
    #: Of the data in a tar, of the local header in a zip.
    offset: int
    packed: int = 0
    #: A zip's method: 0 stored, 8 deflated; None in a tar.
    method: int | None = None
    encrypted: bool = False
    crc: int = 0


@dataclass
class Part(InputPartition):
    path: str
    members: list[Member] = field(default_factory=list)
    #: A compressed tar, streamed through.
    stream: bool = False
    reason: str | None = None

    def __post_init__(self) -> None:
        super().__init__(self.path)


def opened(path: str) -> io.IOBase:
    """A seekable file."""
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    if path.startswith("file://"):
        return open(path.removeprefix("file://"), "rb")
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def expanded(path: str) -> list[str]:
    """The files that a path names, or that the folders hold which it names; one that names none is kept, so that its
    absence is told."""
    if "://" in path and not path.startswith("file://"):
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        if fs.get_file_info(inner).type != pyarrow.fs.FileType.Directory:
            return [path]
        base = path.rstrip("/")
        return sorted(f"{base}/{i.base_name}" for i in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if i.is_file)
    local = path.removeprefix("file://").removeprefix("file:")
    found = sorted(glob.glob(local)) or [local]
    within = lambda p: sorted(e.path for e in os.scandir(p) if e.is_file() and e.name[0] not in "._")
    return [f for p in found for f in (within(p) if os.path.isdir(p) else [p])]


def plan(path: str, wanted: re.Pattern | None, partition_bytes: int) -> list[Part]:
    """The partitions of one archive."""
    try:
        with opened(path) as f:
            head = f.read(4)
            if head[:2] == b"\x1f\x8b" or head == b"\x28\xb5\x2f\xfd":
                return [Part(path, stream=True)]
            f.seek(0)
            members = _zip_members(f) if head[:2] == b"PK" else _tar_members(f)
    except READ_ERRORS as e:
        return [Part(path, reason=why(e))]
    parts, held = [], 0
    for m in members:
        if wanted is None or wanted.fullmatch(m.name):
            if not parts or held + m.packed > partition_bytes:
                parts.append(Part(path))
                held = 0
            parts[-1].members.append(m)
            held += max(m.packed, 4096)
    return parts


def _zip_members(f: io.IOBase) -> list[Member]:
    with zipfile.ZipFile(f) as z:
        return [Member(i.filename, i.file_size, i.header_offset, i.compress_size, i.compress_type, bool(i.flag_bits & 1), i.CRC) for i in z.infolist() if not i.is_dir()]


def _tar_members(f: io.IOBase) -> list[Member]:
    with tarfile.open(fileobj=f, mode="r:") as t:
        return [Member(m.name, m.size, m.offset_data, m.size) for m in t if m.isfile() and not m.issparse()]


def read_member(f: io.IOBase, m: Member, most: int) -> bytes:
    if m.size > most:
        raise Unreadable(f"larger than {most} bytes")
    f.seek(m.offset)
    if m.method is None:
        data = f.read(m.size)
        if len(data) < m.size:
            raise EOFError("the archive ends within the member")
        return data
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise Unreadable("no member where the directory says")
    if m.encrypted:
        raise Unreadable("encrypted")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(m.offset + 30 + name + extra)
    packed = f.read(m.packed)
    if m.method == zipfile.ZIP_STORED:
        data = packed
    elif m.method == zipfile.ZIP_DEFLATED:
        unpack = zlib.decompressobj(-15)
        data = unpack.decompress(packed, m.size + 1)
    else:
        raise Unreadable(f"packed by method {m.method}")
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise Unreadable("not what the directory says of it")
    return data


def _streamed(path: str, wanted: re.Pattern | None, most: int) -> Iterator[tuple]:
    with opened(path) as f:
        if f.read(4) == b"\x28\xb5\x2f\xfd":
            try:
                import zstandard
            except ImportError:
                raise Unreadable("packed by zstandard, which isn't installed") from None
            f.seek(0)
            source: io.IOBase = zstandard.ZstdDecompressor().stream_reader(f)
            opening = tarfile.open(fileobj=source, mode="r|")
        else:
            f.seek(0)
            opening = tarfile.open(fileobj=f, mode="r|gz")
        with opening as t:
            for m in t:
                if m.isfile() and (wanted is None or wanted.fullmatch(m.name)):
                    yield (path, m.name, m.size, None, f"larger than {most} bytes") if m.size > most else (path, m.name, m.size, t.extractfile(m).read(), None)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: CaseInsensitiveDict) -> None:
        self.path = options.get("path") or ""
        self.wanted = options.get("members")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.most = int(options.get("maxMemberBytes", MAX_MEMBER_BYTES))

    def _pattern(self) -> re.Pattern | None:
        return re.compile(self.wanted, re.S) if self.wanted else None

    def partitions(self) -> list[Part]:
        return [p for path in expanded(self.path) for p in plan(path, self._pattern(), self.partition_bytes)] or [Part(self.path)]

    def _rows(self, part: Part) -> Iterator[tuple]:
        if part.reason is not None:
            yield part.path, None, None, None, part.reason
        elif part.stream:
            try:
                yield from _streamed(part.path, self._pattern(), self.most)
            except READ_ERRORS as e:
                yield part.path, None, None, None, why(e)
        elif part.members:
            with opened(part.path) as f:
                for m in part.members:
                    try:
                        yield part.path, m.name, m.size, read_member(f, m, self.most), None
                    except READ_ERRORS as e:
                        yield part.path, m.name, m.size, None, why(e)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """A batch per row: members can be large."""
        for row in self._rows(partition):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archive(spark: SparkSession, path: str, members: str | None = None, **options: int) -> DataFrame:
    """Rows of SCHEMA for the members of a path's archives whose whole names match a regular expression."""
    spark.dataSource.register(Archives)
    r = spark.read.format("archive")
    for k, v in {"members": members, **options}.items():
        r = r.option(k, v) if v is not None else r
    return r.load(path)


def documents(archive: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(JSON documents of the members as columns of schema, with path and member; members and archives that can't be
    read or aren't such JSON: path, member, reason)."""
    text = archive.withColumn("__d", F.from_json(F.col("content").cast("string"), schema, {"mode": "PERMISSIVE"}))
    told = F.coalesce("reason", F.when(F.col("__d").isNull(), "not JSON"))
    names = [f.name for f in text.schema["__d"].dataType.fields]
    empty = F.coalesce(*(F.col(f"__d.{n}").isNotNull().cast("int") for n in names)) if len(names) == 1 else F.greatest(*(F.col(f"__d.{n}").isNotNull().cast("int") for n in names))
    told = F.coalesce(told, F.when(empty == 0, "nothing that is looked for"))
    good = text.filter(told.isNull()).select("path", "member", "__d.*")
    return good, text.filter(told.isNotNull()).select("path", "member", told.alias("reason"))
