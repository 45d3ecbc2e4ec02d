"""Periodic runs of words: stretches that repeat a sequence of q words four times or more, by the runs theorem.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Each run has, under
one of the two orders of the words, a Lyndon root that is the longest Lyndon word at the place where it starts; and the
longest Lyndon word at i ends before the next suffix that is smaller than i's. So

1. the words of a batch of documents become numbers, with an end mark after each document that is smaller than any word;
2. suffixes are ranked by prefix doubling, only those that are still tied each time; common prefixes of neighbours are
   found when a tie breaks, from those that were found before;
3. the next smaller and the next greater rank of each place give the longest Lyndon word under both orders;
4. a root whose next occurrence goes on for two periods more (range minima of the common prefixes, from a sparse table
   over blocks) is extended to both sides, to the left on the reversed words of the documents that have such roots.

Each document is a row of its own and is read whole; batches of documents bound what a task holds (some 100 bytes a
word), and a longer document is a batch of its own.

Defined results: a null or empty text has no words, no runs, four nulls for the longest run and the digests of nothing;
a null doc_id is a document without the change that op12_runs makes by doc_id; rows that repeat are judged one by one;
ties between longest runs go to the smallest start, then period; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from patchweave.llm.common import documents

#: A run's least length: in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that a batch has, unless one document has more.
BATCH_WORDS = 300_000
#: Ranks in a block of the sparse table.
BLOCK = 8
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class RangeMinima:
    """Minima of any range of values: minima of blocks in a sparse table, the rest of a range by looking."""

    def __init__(self, values: np.ndarray) -> None:
        n = -(-max(1, len(values)) // BLOCK)
        padded = np.full(n * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(values)] = values
        self.values, self.levels = padded, [padded.reshape(n, BLOCK).min(axis=1)]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= n:
            top = self.levels[-1]
            self.levels.append(np.minimum(top[:-half], top[half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of values[first..last], ends included; last >= first."""
        out = np.full(len(first), np.iinfo(np.int32).max, np.int32)
        low, high = -(-first // BLOCK), (last + 1) // BLOCK  # whole blocks
        inner = np.flatnonzero(low < high)
        if len(inner):
            width = (high - low)[inner]
            level = np.frexp(width.astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = inner[level == k]
                t = self.levels[k]
                out[at] = np.minimum(t[low[at]], t[high[at] - (1 << int(k))])
        for step in range(BLOCK):
            for p in (first + step, last - step):
                at = np.flatnonzero((p >= first) & (p <= last))
                out[at] = np.minimum(out[at], self.values[p[at]])
        return out


class Suffixes:
    """Ranks and common prefixes of the suffixes of several documents, end marks (0) included.

    A later document's suffixes rank before an earlier one's, so the next smaller suffix never lies beyond the next
    document's start, and no two documents are compared."""

    def __init__(self, word: np.ndarray, doc: np.ndarray) -> None:
        n = len(word)
        after = np.r_[word[1:], 0]
        after[word == 0] = 0
        size = int(word.max(initial=0)) + 1
        key = ((int(doc[-1]) - doc) * size + word) * size + after
        sa = np.argsort(key, kind="stable")
        # Documents are apart by their key; lcp[r] is what the suffixes at ranks r - 1 and r share.
        sorted_key = key[sa]
        new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        lcp = np.full(n, np.iinfo(np.int32).max, np.int32)
        at = np.flatnonzero(new)
        lcp[at] = np.r_[False, sorted_key[1:] // size == sorted_key[:-1] // size][at]
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        h = 2
        while True:
            tied = ~new | np.r_[~new[1:], False]
            places = np.flatnonzero(tied)
            if not len(places):
                break
            s = sa[places]
            group, then = rank[s], rank[s + h]
            order = np.lexsort((then, group))
            s, group, then = s[order], group[order], then[order]
            sa[places] = s
            same = np.r_[False, group[1:] == group[:-1]]
            split = same & np.r_[False, then[1:] != then[:-1]]
            # Apart since now: h words, and what the suffixes behind them share, which are apart already.
            at = np.flatnonzero(split)
            a, b = then[at - 1], then[at]
            lcp[places[at]] = h + RangeMinima(lcp)(a + 1, b)
            new[places[at]] = True
            rank[s] = np.maximum.accumulate(np.where(~same | split, places, 0))
            h *= 2
        self.rank, self.minima = rank, RangeMinima(lcp)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b share."""
        x, y = self.rank[a], self.rank[b]
        return self.minima(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)


def next_smaller(v: np.ndarray) -> np.ndarray:
    """For each i the least j > i with v[j] < v[i]; len(v) where there is none. By levels of minima, up and down."""
    n = len(v)
    levels = [np.r_[v, np.iinfo(v.dtype).min]]
    while len(levels[-1]) > 1:
        t = levels[-1]
        t = np.r_[t, np.iinfo(v.dtype).min] if len(t) % 2 else t
        levels[-1] = t
        levels.append(np.minimum(t[::2], t[1::2]))
    at = np.arange(1, n + 1)
    left, found = np.arange(n), []
    for t in levels:
        # Nodes that are left children have their right neighbours looked at one level higher.
        odd = at & 1 == 1
        hit = np.zeros(len(at), bool)
        hit[odd] = t[np.minimum(at[odd], len(t) - 1)] < v[left[odd]]
        if len(t) == 1:
            hit[:] = True
        found.append((left[hit], at[hit]))
        left, at = left[~hit], (at[~hit] + 1) >> 1
    out = np.empty(n, np.int64)
    who, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        who, node = np.r_[who, found[k][0]], np.r_[node, found[k][1]]
        if k:
            t = levels[k - 1]
            node = node * 2
            node += t[node] >= v[who]
    out[who] = node
    return out


def _roots(s: Suffixes, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, period, words shared with the next occurrence) of longest Lyndon words that go on for two periods more."""
    n, found = len(word), []
    for ranks in (s.rank, -s.rank):
        then = next_smaller(ranks)
        i = np.flatnonzero((then < n) & (word != 0))
        j = then[i]
        same = word[i] == word[j]
        i, j = i[same], j[same]
        shared = s.common(i, j)
        long = shared >= 2 * (j - i)
        found.append((i[long], (j - i)[long], shared[long]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_runs(words: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of each document, given as numbers from 1: rows of (start, length, period), sorted by start, then period."""
    empty = np.zeros((0, 3), np.int64)
    out = [empty] * len(words)
    if not any(len(w) for w in words):
        return out
    word, doc, first = _joined(words)
    i, p, shared = _roots(Suffixes(word, doc), word)
    if not len(i):
        return out
    # To the left: the reversed words of the documents with roots.
    d = doc[i]
    some = np.unique(d)
    back, back_doc, back_first = _joined([words[k][::-1] for k in some])
    at = np.searchsorted(some, d)
    size = np.array([len(words[k]) for k in some])[at]
    local = i - first[d]
    mirror = lambda x: back_first[at] + size - x  # noqa: E731  place after which word x - 1 comes, read backwards
    before = Suffixes(back, back_doc).common(mirror(local), mirror(local + p))
    start, end = local - before, local + p + shared
    length = end - start
    ok = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
    rows = np.unique(np.stack([d, start, p, length], axis=1)[ok], axis=0)
    cuts = np.searchsorted(rows[:, 0], np.arange(len(words) + 1))
    for k in np.unique(rows[:, 0]):
        out[k] = rows[cuts[k] : cuts[k + 1]][:, [1, 3, 2]]
    return out


def _joined(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with a 0 after each document, the document of each, where each document starts)."""
    sizes = np.array([len(w) + 1 for w in words])
    zero = np.zeros(1, np.int64)
    return np.concatenate([x for w in words for x in (w, zero)]), np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word at each place of a document of n words that is made periodic by its id; None if it stays."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _report(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    text = "".join(f"{s},{k},{p}\n" for s, k, p in runs.tolist())
    if len(runs):
        words = [words[i] for i in np.flatnonzero(~dropped(len(words), runs))]
        start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        top = (start, length, period, 1000 * length // period)
    else:
        top = (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def _batched(batches: Iterator[pa.RecordBatch], change: Callable[[int | None, int], np.ndarray | None]) -> Iterator[tuple[list, list[list[bytes]], list[np.ndarray]]]:
    """(ids, words, runs) of batches of documents of BATCH_WORDS words or little more."""
    ids, texts, numbers, of, held = [], [], [], _Numbers(), 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = (t.as_py() or "").encode().split()  # bytes.split() parts at the six ASCII blanks only
            if held and held + len(words) > BATCH_WORDS:
                yield ids, texts, find_runs(numbers)
                ids, texts, numbers, of, held = [], [], [], _Numbers(), 0
            at = change(i, len(words))
            if at is not None:
                words = [words[k] for k in at.tolist()]
            ids.append(i)
            texts.append(words)
            numbers.append(np.fromiter(map(of.__getitem__, words), np.int64, len(words)))
            held += len(words)
    if ids:
        yield ids, texts, find_runs(numbers)


def unchanged(doc_id: int | None, n: int) -> None:
    return None


def run_reports(docs: DataFrame, change: Callable[[int | None, int], np.ndarray | None] = unchanged) -> DataFrame:
    """RUNS of each row of docs: the number of runs, the longest one, and digests of all runs and of the words without
    repeats. change: the original word for each place, for documents that are judged with other words than their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _batched(batches, change):
            rows = [_report(*x) for x in zip(ids, words, runs, strict=True)]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in RUNS.split(", ")])

    return docs.selectExpr("cast(doc_id as long)", "text").mapInArrow(run, RUNS)


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, runs and text (words joined by one space, each run cut to its first period) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _batched(batches, unchanged):
            spans = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x in runs]
            kept = [b" ".join(w[k] for k in np.flatnonzero(~dropped(len(w), x))).decode() for w, x in zip(words, runs, strict=True)]
            span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=["doc_id", "runs", "text"])

    return docs.selectExpr("cast(doc_id as long)", "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def op12_runs(spark, sf_dir: str) -> DataFrame:
    return run_reports(documents(spark, sf_dir), planted)
