"""Rows of one table of an SQLite file, from its pages: https://www.sqlite.org/fileformat2.html.

A package database comes from an image that nobody vouches for. The file is checked as a whole before a row is taken:
its length is what its header says, every page of the table's tree is visited once and is of the right kind, cells and
chains of overflow pages stay within their pages. Anything else is Unreadable: a damaged file never yields fewer rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

MAGIC = b"SQLite format 3\0"
#: Fixed values of the format: kinds of pages of a table's tree, bytes of serial types below 12.
_INTERIOR, _LEAF = 5, 13
_SIZES = (0, 1, 2, 3, 4, 6, 8, 8, 0, 0)
MAX_DEPTH = 40


class Damaged(ValueError):
    """The file isn't a whole database of this format."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it): seven bits a byte, high first, and eight of the ninth."""
    value = 0
    for i in range(9):
        if at + i >= len(data):
            raise Damaged("a number beyond its page")
        b = data[at + i]
        if i == 8:
            return value << 8 | b, at + 9
        value = value << 7 | b & 127
        if b < 128:
            return value, at + i + 1
    raise AssertionError


class Pages:
    def __init__(self, data: bytes) -> None:
        if not data.startswith(MAGIC) or len(data) < 512:
            raise Damaged("not an SQLite database")
        size = int.from_bytes(data[16:18], "big")
        self.size = 65_536 if size == 1 else size
        if self.size < 512 or self.size & (self.size - 1):
            raise Damaged(f"a page size of {self.size}")
        self.usable = self.size - data[20]
        if self.usable < 480 or data[21:24] != b"\x40\x20\x20":
            raise Damaged("a header that no database has")
        if int.from_bytes(data[56:60], "big") not in (0, 1):
            raise Damaged("text in another encoding than UTF-8")
        self.count = len(data) // self.size
        told = int.from_bytes(data[28:32], "big")
        if len(data) % self.size or (data[24:28] == data[92:96] and told != self.count):
            raise Damaged(f"{len(data)} bytes, where the header tells of {told} pages of {self.size}")
        self.data, self.seen = data, set()

    def page(self, n: int) -> bytes:
        """A page, once: trees and chains share none."""
        if not 1 <= n <= self.count or n in self.seen:
            raise Damaged(f"page {n} twice or beyond the {self.count} that there are")
        self.seen.add(n)
        return self.data[(n - 1) * self.size : n * self.size]

    def payloads(self, root: int, depth: int = 0) -> Iterator[bytes]:
        """The records of a table's tree, in the order of their keys."""
        if depth > MAX_DEPTH:
            raise Damaged("a tree that is too deep")
        p, base = self.page(root), 100 if root == 1 else 0
        kind, cells = p[base], int.from_bytes(p[base + 3 : base + 5], "big")
        if kind not in (_INTERIOR, _LEAF):
            raise Damaged(f"page {root} is of kind {kind}, no page of a table")
        head = base + (12 if kind == _INTERIOR else 8)
        if head + 2 * cells > self.usable:
            raise Damaged(f"page {root} has more cells than fit")
        for i in range(cells):
            at = int.from_bytes(p[head + 2 * i : head + 2 * i + 2], "big")
            if not head + 2 * cells <= at < self.usable:
                raise Damaged(f"a cell of page {root} lies beyond it")
            if kind == _INTERIOR:
                yield from self.payloads(int.from_bytes(p[at : at + 4], "big"), depth + 1)
            else:
                yield self._payload(p, at)
        if kind == _INTERIOR:
            yield from self.payloads(int.from_bytes(p[base + 8 : base + 12], "big"), depth + 1)

    def _payload(self, p: bytes, at: int) -> bytes:
        length, at = _varint(p, at)
        _, at = _varint(p, at)  # the key
        if length > len(self.data):
            raise Damaged("a record larger than the file")
        held = length
        if length > self.usable - 35:  # the rest is in overflow pages
            least = (self.usable - 12) * 32 // 255 - 23
            held = least + (length - least) % (self.usable - 4)
            held = held if held <= self.usable - 35 else least
        if at + held + (4 if held < length else 0) > self.usable:
            raise Damaged("a record beyond its page")
        out, following = bytearray(p[at : at + held]), int.from_bytes(p[at + held : at + held + 4], "big") if held < length else 0
        while len(out) < length:
            q = self.page(following)
            out += q[4 : 4 + min(self.usable - 4, length - len(out))]
            following = int.from_bytes(q[:4], "big")
            if (following == 0) != (len(out) == length):
                raise Damaged("overflow pages that end too early or too late")
        return bytes(out)


def columns(record: bytes) -> list[bytes | int | None]:
    """A record's values: blobs and texts as bytes, integers, None; other numbers are None, too."""
    end, at = _varint(record, 0)
    kinds = []
    while at < end:
        kind, at = _varint(record, at)
        kinds.append(kind)
    if at != end:
        raise Damaged("a record's head beyond its end")
    out: list[bytes | int | None] = []
    for kind in kinds:
        if kind in (10, 11):
            raise Damaged(f"a value of the unused kind {kind}")
        size = _SIZES[kind] if kind < 10 else (kind - 12) // 2
        if at + size > len(record):
            raise Damaged("a value beyond its record")
        v = record[at : at + size]
        out.append(v if kind >= 12 else int.from_bytes(v, "big", signed=True) if 1 <= kind <= 6 else kind - 8 if kind in (8, 9) else None)
        at += size
    if at != len(record):
        raise Damaged("a record that goes on after its values")
    return out


def table_column(data: bytes, table: str, column: str) -> list[bytes | int | None]:
    """A column of all rows of a table, by the names in the file's own catalogue."""
    pages = Pages(data)
    for kind, name, _, root, sql in (columns(r)[:5] for r in list(pages.payloads(1))):
        if kind == b"table" and isinstance(name, bytes) and name.decode("utf-8", "replace").lower() == table.lower() and isinstance(root, int):
            inner = re.search(r"\((.*)\)", (sql or b"").decode("utf-8", "replace"), re.S) if isinstance(sql, bytes) else None
            names = [(c.split() or [""])[0].strip("\"'`[]").lower() for c in inner[1].split(",")] if inner else []
            if column.lower() not in names:
                raise Damaged(f"the table {table} has no column {column}")
            at = names.index(column.lower())
            rows = [columns(r) for r in pages.payloads(root)]
            if any(len(r) <= at for r in rows):
                raise Damaged(f"a row without {column}")
            return [r[at] for r in rows]
    raise Damaged(f"no table {table}")
