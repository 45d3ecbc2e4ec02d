"""Removal of passages that documents with smaller ids hold, too, by difference-cover anchors.

A set of residues modulo a period is a difference cover if every difference is one of two of its members. Words at
cover positions of a document are anchors: for any two places, and so for any two equal windows, some offset below the
period puts both on the cover, so hashing the anchors alone (six positions of 31) loses no window. An anchor is as long
as still fits a window at each such offset.

1. Anchors of equal words form classes. Each anchor of a class with two documents or more learns an occurrence in a
   smaller document, or that it is itself of the first one.
2. Matches extend. Anchors overlap, so a chain of consecutive anchors that lead to one document at one distance proves
   all its words equal, and the windows inside it are settled. Windows around other shared anchors are hashed whole
   (128 bits) and form classes in turn; a window is repeated if it isn't of the first document of its class.
3. Words of repeated windows go.

Classes are folded twice: in each task, where all but the first document's rows are settled at once, and then in
streams sorted by hash. So a passage that a third of all documents hold costs a row per task, no class is ever gathered
but for a row per chunk of MAX_ROWS, and no pairs are made. A false match needs equal 64-bit hashes of two anchors in
place, or equal 128-bit hashes of two windows.

Defined results: a null or empty text has no words; a text shorter than a window stays whole; rows without doc_id stay
whole and repeat nothing, as no id is known to be smaller; rows that share a doc_id are documents of their own, neither
smaller than the other; passages that repeat within one document only stay; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import documents, drop_table, with_ids, write_table

WINDOW = 50
#: Perfect difference covers: each difference but 0 occurs once.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
#: Rows that a task folds at once.
MAX_ROWS = 1 << 20
#: Distinct words whose hashes a task keeps.
MAX_WORDS = 1 << 20
FOLDED = "key long, key2 long, doc long, pos int, span int, m long, mpos int, shared boolean"
_SCHEMA = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("span", pa.int32()), ("m", pa.int64()), ("mpos", pa.int32()), ("shared", pa.bool_())])


class _Hashes(dict):
    """64-bit hashes of words, the last MAX_WORDS or fewer of them kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """bytes.split() parts at the six ASCII blanks only."""
    return (text or "").encode().split()


def rolling(h: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hash of each stretch of so many words: polynomials composed by doubling, then mixed."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(int(base), k, 1 << 64))
    out, done, part, size = None, 0, h, 1
    while True:
        if length & size:
            if out is None:
                out, done = part, size
            else:
                m = len(h) - done - size + 1
                out, done = out[:m] * power(size) + part[done : done + m], done + size
        if size * 2 > length:
            break
        m = len(h) - 2 * size + 1
        part, size = part[:m] * power(size) + part[size : size + m], size * 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Cover:
    """The anchors of a window length."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.period = max((p for p in COVERS if 3 * p <= 2 * window), default=0)
        if not self.period:
            raise ValueError("a window has 11 words at least")
        self.residues = np.array(COVERS[self.period])
        self.anchor = window - self.period + 1

    def positions(self, n: int) -> np.ndarray:
        all_of = (np.arange(0, max(n, 0), self.period)[:, None] + self.residues).ravel()
        return all_of[all_of <= n - self.anchor]

    def order(self, positions: np.ndarray) -> np.ndarray:
        """Which anchor of its document each position is."""
        return positions // self.period * len(self.residues) + np.searchsorted(self.residues, positions % self.period)


def _fold(key, key2, doc, pos, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, m, mpos, is_first, shared): rows sorted by class; which of them are of their class's first document, that
    document and its first position, and whether the class has others."""
    order = np.lexsort((pos, doc, key2, key))
    key, key2, doc, pos, shared = key[order], key2[order], doc[order], pos[order], shared[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])]
    starts = np.flatnonzero(new)
    at = np.cumsum(new) - 1
    m, mpos = doc[starts][at], pos[starts][at]
    first = doc == m
    more = np.logical_or.reduceat(shared | ~first, starts)[at]
    return order, m, mpos, first, more


def _rows(key, key2, doc, pos, span, m, mpos, linked, shared) -> pa.RecordBatch:
    no = ~linked
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(doc), pa.array(pos, pa.int32()), pa.array(span, pa.int32()), pa.array(m, pa.int64(), mask=no), pa.array(mpos, pa.int32(), mask=no), pa.array(shared)],
        schema=_SCHEMA,
    )


class _Chunk:
    """Rows of a task, folded when there are MAX_ROWS."""

    def __init__(self) -> None:
        self.parts, self.held = [], 0

    def add(self, key, key2, doc: int, pos) -> Iterator[pa.RecordBatch]:
        if len(pos):
            once = np.unique(key, return_index=True)[1]  # what repeats within the document is settled by its hash
            self.parts.append((key[once], key2[once], np.full(len(once), doc, np.int64), pos[once].astype(np.int32)))
            self.held += len(once)
        if self.held >= MAX_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            key, key2, doc, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.held = [], 0
            order, m, mpos, first, more = _fold(key, key2, doc, pos, np.zeros(len(key), bool))
            out = _rows(key[order], key2[order], doc[order], pos[order], np.ones(len(key), np.int32), m, mpos, ~first, more)
            yield from (out.slice(i, 100_000) for i in range(0, len(key), 100_000))


def _sorted_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by class: links those that have none, and keeps first documents' rows only of shared classes."""
    held: pa.Table | None = None

    def settle(t: pa.Table) -> pa.RecordBatch:
        c = {n: t.column(n).to_numpy() for n in ("key", "key2", "doc", "pos", "span", "shared")}
        order, m, mpos, first, more = _fold(*(c[n] for n in ("key", "key2", "doc", "pos", "shared")))
        out = _rows(*(c[n][order] for n in ("key", "key2", "doc", "pos", "span")), m, mpos, ~first, more)
        return out.filter(pa.array(more))

    def blocks() -> Iterator[pa.Table]:
        parts, n = [], 0
        for b in batches:
            parts.append(b)
            n += b.num_rows
            if n >= 1 << 17:
                yield pa.Table.from_batches(parts)
                parts, n = [], 0
        if n:
            yield pa.Table.from_batches(parts)

    for t in blocks():
        done = np.asarray(t.column("m").is_valid())
        if done.any():
            yield from t.filter(pa.array(done)).to_batches()
            t = t.filter(pa.array(~done))
        if not t.num_rows:
            continue
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        key, key2 = t.column("key").to_numpy(), t.column("key2").to_numpy()
        last = np.flatnonzero((key != key[-1]) | (key2 != key2[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last class may go on
        held = t.slice(cut)
        if cut:
            yield settle(t.slice(0, cut))
    if held is not None and held.num_rows:
        yield settle(held)


def classes(rows: DataFrame) -> DataFrame:
    """Rows of FOLDED, folded in their tasks: those with a link to a smaller document (m, mpos), and those of the first
    documents of classes with others (m null)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.when(F.col("m").isNull(), F.xxhash64("key", "key2")).otherwise(F.xxhash64("doc", "pos"))
    dealt = rows.withColumn("place", place).repartition(n, "place").drop("place")
    return dealt.sortWithinPartitions(F.col("m").isNotNull(), "key", "key2", "doc", "pos").mapInArrow(_sorted_fold, FOLDED)


def _columns(b: pa.RecordBatch, *names: str) -> list:
    return [b.column(b.schema.get_field_index(n)) for n in names]


def _anchors(cover: Cover):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunk = _Hashes(), _Chunk()
        for b in batches:
            ids, texts = _columns(b, "doc_id", "text")
            for i, t in zip(ids.to_pylist(), texts, strict=True):
                w = words(t.as_py())
                if len(w) >= cover.window:
                    p = cover.positions(len(w))
                    key = rolling(hashes.of(w), cover.anchor, BASES[0])[p]
                    yield from chunk.add(key, np.zeros(len(p), np.uint64), i, p)
        yield from chunk.flush()

    return run


def _stretch(key: np.ndarray, pos: int, span: int) -> int:
    """What names the windows of a stretch: the one's hash, or a hash of their hashes."""
    return int(key[pos : pos + span].view(np.int64)[0]) if span == 1 else int(np.uint64(xxhash.xxh3_64_intdigest(key[pos : pos + span].tobytes())).view(np.int64))


def _each(links: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """The links of each document as arrays; mpos is -1 where a link leads nowhere."""
    flat, at = links.values, links.offsets.to_numpy()
    cols = {n: pc.fill_null(flat.field(n), -1 if n == "mpos" else 0).to_numpy(zero_copy_only=False) for n in ("pos", "span", "key", "m", "mpos")}
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield {n: c[a:b] for n, c in cols.items()}


def _shared(x: dict[str, np.ndarray], pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, m, mpos) of the anchors, given by position and hash, that links name. A link stands for all anchors of its
    hash, and leads somewhere for the one that it was made of; so rows that share a doc_id don't take each other's."""
    known, first = np.unique(x["key"], return_index=True)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    mine = known[at] == key
    pos, of = pos[mine], first[at[mine]]
    return pos, x["m"][of], np.where(x["pos"][of] == pos, x["mpos"][of], -1)


def _windows(cover: Cover):
    """Documents with their shared anchors -> windows: settled ones, a row per stretch, and those to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunk = _Hashes(), _Chunk()
        for b in batches:
            ids, texts, links = _columns(b, "doc_id", "text", "links")
            for i, t, x in zip(ids.to_pylist(), texts, _each(links), strict=True):
                h = hashes.of(words(t.as_py()))
                if len(h) < cover.window:
                    continue
                p = cover.positions(len(h))
                pos, m, mpos = _shared(x, p, rolling(h, cover.anchor, BASES[0])[p].view(np.int64))
                if not len(pos):
                    continue
                at, linked = cover.order(pos), mpos >= 0
                goes_on = (at[1:] == at[:-1] + 1) & linked[1:] & linked[:-1] & (m[1:] == m[:-1]) & (mpos[1:] - pos[1:] == mpos[:-1] - pos[:-1])
                start = np.flatnonzero(np.r_[True, ~goes_on])
                end = np.r_[start[1:], len(pos)] - 1
                spans = pos[end] + cover.anchor - cover.window - pos[start] + 1
                long = spans > 0
                start, spans = start[long], spans[long]
                # Windows that hold a shared anchor, without the settled ones.
                n = len(h) - cover.window + 1
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.maximum(pos + cover.anchor - cover.window, 0), 1)
                np.add.at(edge, np.minimum(pos + 1, n), -1)
                open_ = np.cumsum(edge[:-1]) > 0
                for s, k in zip(pos[start], spans, strict=True):
                    open_[s : s + k] = False
                one, two = (rolling(h, cover.window, base) for base in BASES)
                if len(start):
                    s, true = pos[start], np.ones(len(start), bool)
                    key = np.array([_stretch(one, *y) for y in zip(s, spans, strict=True)], np.int64)
                    yield _rows(key, two[s], np.full(len(s), i, np.int64), s, spans, m[start], mpos[start], true, true)
                s = np.flatnonzero(open_)
                yield from chunk.add(one[s], two[s], i, s)
        yield from chunk.flush()

    return run


STRIPPED = "doc_id long, n_words long, n_removed long, kept_text string"


def _strip(cover: Cover):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            ids, texts = _columns(b, "doc_id", "text")
            links = _columns(b, "links")[0] if "links" in b.schema.names else None
            count, gone, kept = [], [], []
            each = iter(()) if links is None else _each(links)
            for t in texts:
                w, x = words(t.as_py()), next(each, None)
                count.append(len(w))
                gone.append(0)
                if x is not None and len(w) >= cover.window:
                    key = rolling(hashes.of(w), cover.window, BASES[0])
                    edge = np.zeros(len(w) + 1, np.int64)
                    pos = np.flatnonzero(np.isin(key.view(np.int64), x["key"][x["span"] == 1]))
                    edge[pos] += 1
                    edge[pos + cover.window] -= 1
                    for a, n, k in zip(*(x[c][x["span"] > 1].tolist() for c in ("pos", "span", "key")), strict=True):
                        if a + n <= len(key) and _stretch(key, a, n) == k:
                            edge[a] += 1
                            edge[a + n - 1 + cover.window] -= 1
                    stays = np.cumsum(edge[:-1]) == 0
                    gone[-1] = len(w) - int(stays.sum())
                    w = [w[k] for k in np.flatnonzero(stays)]
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _per_document(rows: DataFrame) -> DataFrame:
    """A document has fewer rows than words."""
    return rows.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("pos", "span", "key", "m", "mpos")).alias("links"))


def strip_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row of docs."""
    cover, docs = Cover(window), docs.select(F.col("doc_id").cast("long"), "text")
    anchors = write_table(classes(docs.filter("doc_id is not null").mapInArrow(_anchors(cover), FOLDED)), "op11-anchors")
    ids = write_table(anchors.select(F.col("doc").alias("doc_id")).distinct(), "op11-sharing")
    met = with_ids(docs, ids).join(_per_document(anchors), "doc_id").select("doc_id", "text", "links")
    windows = write_table(classes(met.mapInArrow(_windows(cover), FOLDED)).filter("m is not null"), "op11-windows")
    changed = write_table(windows.select(F.col("doc").alias("doc_id")).distinct(), "op11-changed")
    for old in (anchors, ids):
        drop_table(old)
    cut = with_ids(docs, changed).join(_per_document(windows), "doc_id").select("doc_id", "text", "links")
    return cut.mapInArrow(_strip(cover), STRIPPED).unionByName(with_ids(docs, changed, "left_anti").mapInArrow(_strip(cover), STRIPPED))


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return strip_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(len(w) - 49)) AS i, w FROM t WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
p AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM t),
m AS (SELECT p.doc_id, p.i, p.word, max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i),
k AS (SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
