"""Bounded-space online packing of token sequences.

Each partition packs its documents as they come. A fixed number of windows is open; a piece goes to the open window
with the least room that still holds it (best fit). Where none does and all windows are in use, the fullest one is
filled up with the head of the piece and emitted. At the end the open windows are merged: their pieces are laid end to
end, whole sequences are cut off, and the rest is cut into powers of two, which need no padding. So a sequence is
2048 tokens long or a power of two, and nothing is padded.

Texts are tokenised by white-space chunks; the tokenizer never joins chunks, so the ids are those of the whole text. A
worker keeps the ids of chunks in arrays of bounded size, by two 64-bit hashes: a wrong id needs two chunks of at most
48 bytes that agree in both. There is no shuffle, and a lost task packs its partition again alike.

Defined results: a null or empty text is the end token alone; texts of any length are cut freely; rows that repeat are
packed as often as they occur; a null doc_id stays null; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import documents

WINDOW = 2_048
OPEN_WINDOWS = 16
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Texts that are tokenised together.
BATCH = 64
#: Slots of the chunk table at most, a power of two; 22 bytes each. It starts anew when it is two thirds full.
_SLOTS = 1 << 19
#: Ids that are held for chunks at most, 4 bytes each.
_POOL = 1 << 21
_LONGEST_CACHED = 48
#: Pre-tokens of one call of the tokenizer; bytes that are hashed at a time.
_PER_CALL, _BLOCK = 4_000, 1 << 16

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: Letters that are lower-cased one by one and are composed already; with the rest of ASCII's visible characters, chunks
#: of them alone are cut into pre-tokens here, as the tokenizer cuts them.
_LOWER = "a-zß-öø-ÿœ"
_COMMON = re.compile(f"[\\n!-~{_LOWER}À-ÖØ-ÞŒ]*")
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LOWER}]+|[0-9]|[^\\s0-9{_LOWER}]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd bases and multipliers of the two hashes of a chunk.
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For both bases: their powers modulo 2**64 up to n, and those of their inverses."""
    inverse = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64)
    up, down = (np.cumprod(np.concatenate([np.ones((2, 1), np.uint64), np.repeat(b[:, None], n, axis=1)], axis=1), axis=1, dtype=np.uint64) for b in (_BASES, inverse))
    return up, down


class _Table:
    """Open addressing: the 128-bit hash of a chunk -> where its ids lie in the pool, and how many."""

    def __init__(self) -> None:
        self.reset()

    def reset(self, bits: int = 16) -> None:
        self.used, self.end = 0, 0
        self.pool = np.zeros(1 << 16, "<u4")
        self._slots(bits)

    def _slots(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.key, self.check = (np.zeros(1 << bits, np.uint64) for _ in range(2))
        self.start, self.count = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint16)

    def keep(self, ids: np.ndarray) -> int:
        """Appends ids to the pool; returns where they start."""
        at, self.end = self.end, self.end + len(ids)
        if self.end > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(2 * self.end - at, "<u4")])
        self.pool[at : self.end] = ids
        return at

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, whether it is there) of each chunk."""
        slot = (key & np.uint64(self.mask)).astype(np.int64)
        held = self.key[slot]
        open_ = np.flatnonzero((held != 0) & ((held != key) | (self.check[slot] != check)))
        while len(open_):
            slot[open_] = s = (slot[open_] + 1) & self.mask
            held = self.key[s]
            open_ = open_[(held != 0) & ((held != key[open_]) | (self.check[s] != check[open_]))]
        return self.start[slot].astype(np.int64), self.count[slot].astype(np.int64), self.key[slot] != 0

    def add(self, key: np.ndarray, check: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Adds chunks that aren't there, each once."""
        while 3 * (self.used + len(key)) > 2 * (self.mask + 1):
            at = np.flatnonzero(self.key)
            old = self.key[at], self.check[at], self.start[at], self.count[at]
            self._slots((self.mask + 1).bit_length())
            self._put(*old)
        self._put(key, check, start, count)
        self.used += len(key)

    def _put(self, key: np.ndarray, check: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        slot, todo = (key & np.uint64(self.mask)).astype(np.int64), np.arange(len(key))
        owner = np.empty(len(key), np.int64)
        while len(todo):
            s = slot[todo]
            free = self.key[s] == 0
            mine, at = todo[free], s[free]
            # Of those that want the same slot the last one gets it.
            self.start[at] = mine
            won = self.start[at] == mine
            at, got = at[won], mine[won]
            self.key[at], owner[got] = key[got], at
            todo = np.setdiff1d(todo, got, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
        self.check[owner], self.start[owner], self.count[owner] = check, start, count


class ChunkTokenizer:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        # The same vocabulary and merges for pre-tokens, which lie between blanks and are normalised already.
        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        size = self.parts.get_vocab_size()
        self.ends = np.array([(self.parts.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.table = _Table()
        self.up, self.down = _powers(_BLOCK + _LONGEST_CACHED + 1)

    @cached_property
    def tokenizer(self):
        """The tokenizer as it is; many tables never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, chunks: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
        """Ids of chunks, end to end; how many each has; the order of the chunks in them."""
        common, other = [], []
        text = "\n".join(chunks)
        every = "<|" not in text and _COMMON.fullmatch(text)
        for i, c in enumerate(chunks):
            (common if every or ("<|" not in c and _COMMON.fullmatch(c)) else other).append(i)
        lows = "\n".join([chunks[i] for i in common]).lower().split("\n") if common else []
        parts: list[str] = []
        stop = []
        for low in lows:
            if low.isalpha():
                parts.append(low)
            else:
                parts += _PARTS.findall(low)
            stop.append(len(parts))
        rest = []
        for i in other:
            # Letters of any script with at most one mark behind them, unless they change when they are normalised or lower-cased.
            c = chunks[i]
            core = c[:-1] if c[-1] == "." or c[-1] == "," else c
            low = core.lower()
            if core.isalpha() and low.isalpha() and "Σ" not in core and is_normalized("NFC", core):
                parts += [low] if core is c else [low, c[-1]]
                stop.append(len(parts))
                common.append(i)
            else:
                rest.append(i)
        # A pre-token ends with the one token that is marked as a word's end.
        calls = (self.parts.encode_batch_fast([" ".join(parts[k : k + _PER_CALL])], add_special_tokens=False)[0].ids for k in range(0, len(parts), _PER_CALL))
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(x, "<u4") for x in calls)])
        ends = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
        if len(ends) != len(parts) + 1 or ends[-1] != len(ids):
            common, rest, ids, cuts = [], list(range(len(chunks))), ids[:0], np.zeros(1, np.int64)
        else:
            cuts = ends[np.array([0, *stop])]
        singly = [self.whole(chunks[i]) for i in rest]
        return [ids, *singly], np.r_[np.diff(cuts), [len(x) for x in singly]].astype(np.int64), common + rest

    def ids(self, texts: list[str]) -> list[bytes]:
        table = self.table
        if 3 * table.used > 2 * _SLOTS or table.end > _POOL:
            table.reset()
        data = [t.encode() for t in texts]
        bounds = np.cumsum([0, *(len(x) + 1 for x in data)])
        joined = b" ".join([*data, b""])
        buf = np.frombuffer(joined, np.uint8)
        edges = np.flatnonzero(np.diff(np.r_[True, _SPACE[buf], True]))
        starts, stops = edges[::2], edges[1::2]
        key, check = self._hashes(buf, starts, stops)
        start, count, there = table.find(key, check)
        # Long chunks are learnt where they occur.
        lost = np.flatnonzero(~there | (stops - starts > _LONGEST_CACHED))
        if len(lost):
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(joined[i:k], len(number)) for i, k in zip(starts[lost].tolist(), stops[lost].tolist(), strict=True)])
            found, counts, order = self._learn(b"\n".join(number).decode().split("\n"))
            at = table.keep(np.concatenate(found))
            begin, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            begin[order], many[order] = at + np.cumsum(counts) - counts, counts
            start[lost], count[lost] = begin[which], many[which]
            first = np.unique(which, return_index=True)[1]
            new = lost[first[stops[lost[first]] - starts[lost[first]] <= _LONGEST_CACHED]]
            # Two chunks of one key, which differ in the other hash, would need a slot each; only the first gets one.
            new = new[np.unique(key[new], return_index=True)[1]]
            table.add(key[new], check[new], start[new], count[new])
        total = np.r_[0, np.cumsum(count)]
        out = table.pool[np.repeat(start - total[:-1], count) + np.arange(total[-1])].tobytes()
        cuts = (4 * total[np.searchsorted(starts, bounds)]).tolist()
        return [out[i:k] for i, k in zip(cuts[:-1], cuts[1:], strict=True)]

    def _hashes(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each chunk that isn't too long to be held; the first is never 0."""
        stops = np.minimum(stops, starts + _LONGEST_CACHED + 1)
        found = np.zeros((2, len(starts)), np.uint64)
        for at in range(0, len(buf), _BLOCK):
            i, k = np.searchsorted(starts, [at, at + _BLOCK])
            values = buf[at : at + _BLOCK + _LONGEST_CACHED + 1].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(values) + 1, np.uint64)
            for h, up, down in zip(found, self.up, self.down, strict=True):
                np.cumsum(values * up[: len(values)], out=sums[1:])
                x = (sums[stops[i:k] - at] - sums[starts[i:k] - at]) * down[starts[i:k] - at]
                x ^= x >> np.uint64(31)
                x *= _MIX
                h[i:k] = x ^ (x >> np.uint64(29))
        return np.maximum(found[0], np.uint64(1)), found[1]


class Packer:
    """Packs byte strings of 4-byte ids; emit(pieces) gets each finished sequence as a list of (tag, start, ids)."""

    def __init__(self, emit, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.emit, self.window, self.most = emit, window, open_windows
        #: (room, number) of the open windows, sorted; contents by number.
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.next = 0

    def add(self, tag, ids: bytes) -> None:
        at, n = 0, len(ids) // 4
        while n - at >= self.window:
            self.emit([(tag, at, ids[4 * at : 4 * (at + self.window)])])
            at += self.window
        while at < n:
            need = n - at
            k = bisect_left(self.rooms, (need, -1))
            if k == len(self.rooms):
                if len(self.rooms) < self.most:
                    insort(self.rooms, (self.window, self.next))
                    self.held[self.next] = []
                    self.next += 1
                    continue
                k, need = 0, self.rooms[0][0]  # the fullest takes the head of the piece
            room, number = self.rooms.pop(k)
            self.held[number].append((tag, at, ids[4 * at : 4 * (at + need)]))
            at += need
            if room == need:
                self.emit(self.held.pop(number))
            else:
                insort(self.rooms, (room - need, number))

    def close(self) -> None:
        """Merges the open windows, the fullest first."""
        rest = [p for _, number in self.rooms for p in self.held[number]]
        total = sum(len(p[2]) // 4 for p in rest)
        sizes = [self.window] * (total // self.window) + [1 << b for b in range(self.window.bit_length() - 1, -1, -1) if (total % self.window) >> b & 1]
        rest.reverse()
        for size in sizes:
            out = []
            while size:
                tag, start, ids = rest.pop()
                n = min(size, len(ids) // 4)
                out.append((tag, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    rest.append((tag, start + n, ids[4 * n :]))
                size -= n
            self.emit(out)
        self.rooms, self.held = [], {}


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def _tokenizer(name: str) -> ChunkTokenizer:
    """The worker's tokenizer, which its tasks share. Tasks get the packing closure with copies of the globals that it
    names; this function is imported, so its table is the worker's own."""
    if name not in _TOKENIZERS:
        import public_tokenizers

        _TOKENIZERS[name] = ChunkTokenizer(public_tokenizers.path(name))
    return _TOKENIZERS[name]


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(tokenizer).ids, END_ID.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        n = 0

        def emit(pieces: list) -> None:
            nonlocal n
            offset = 0
            for (doc_id, tokens), start, ids in pieces:
                length = len(ids) // 4
                rows.append((doc_id, start, length, ids, tokens, first + n, offset))
                offset += length
            n += 1

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        packer = Packer(emit, window, open_windows)
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    packer.add((doc_id, len(ids) // 4 + 1), ids + end)
                if len(rows) >= 500:
                    yield out()
        packer.close()
        yield out()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_pack(spark, sf_dir: str) -> DataFrame:
    return digests(pack(documents(spark, sf_dir)))
