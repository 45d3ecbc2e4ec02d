"""Substring deduplication, periodic runs and hard negatives against brute force and on awkward tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchweave.llm import hard_negatives, runs, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# ---- 11 ----


@pytest.mark.parametrize("period", sorted(substring_dedup.COVERS))
def test_covers(period):
    cover = substring_dedup.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    c = substring_dedup.Cover(3 * period // 2 + 2)
    assert c.period == period and max(np.diff([*cover, period])) <= c.anchor  # a chain leaves no word out
    p = c.positions(10 * period)
    assert c.order(p).tolist() == list(range(len(p)))


def plain_repeats(rows, window):
    """By doc_id alone: kept words of each (doc_id, text)."""
    least, out = {}, []
    parts = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in parts:
        for s in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[s : s + window])
                least[k] = min(least.get(k, i), i)
    for i, w in parts:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def stripped(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window", [12, 50])
def test_repeats_against_brute_force(spark, window, monkeypatch):
    rng = random.Random(window)
    word = lambda k: " ".join(rng.choice("abcdefgh") + str(rng.randrange(k)) for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word(9) for _ in range(window)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice([rng.choice(passages), " ".join(rng.choice(passages).split()[rng.randrange(9) :]), word(1000), "x " * rng.randrange(3 * window)]) for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(90), rng.choice([" ", "\n", "\t \r"]).join(parts)))
    rows += [(i, rows[3][1] + " end") for i in (500, 501, 501)] + [(None, rows[3][1]), (None, rows[3][1]), (502, None), (503, ""), (502, " \x0b")]
    want = sorted(plain_repeats(rows, window), key=repr)
    assert sum(x[2] for x in want) > 1000
    docs = documents(spark, rows)
    assert stripped(substring_dedup.strip_repeats(docs, window)) == want
    monkeypatch.setattr(substring_dedup, "MAX_ROWS", 50)  # classes of many chunks
    assert stripped(substring_dedup.strip_repeats(docs.repartition(7), window)) == want


def test_repeats_of_awkward_tables(spark):
    empty = documents(spark, [(1, "a")]).filter("false")
    assert substring_dedup.strip_repeats(empty).count() == 0
    long = "w%d " * 60_000 % tuple(range(60_000))
    docs = documents(spark, [(2, long), (1, long + "end")])
    for c in ("links", "key", "pos", "m", "kept_text", "n_words", "span"):
        docs = docs.withColumn(c, F.lit("x"))
    assert [(r[0], r[1], r[2]) for r in stripped(substring_dedup.strip_repeats(docs))] == [(1, 60_001, 0), (2, 60_000, 60_000)]
    with pytest.raises(ValueError):
        substring_dedup.Cover(10)


# ---- 12 ----


def plain_runs(w):
    found, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                found.add((i, size, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 3, 7, 20, 60]), rng.choice([1, 2, 2, 3, 5])
            w = [rng.randint(1, k) for _ in range(n)]
            block = [rng.randint(1, k) for _ in range(rng.randint(1, 6))]
            docs.append(w[: n // 2] + (block * 40)[: rng.choice([0, rng.randint(1, 60)])] + w[n // 2 :])
        got = runs.find_runs([np.array(d, np.int64) for d in docs])
        assert [[tuple(r) for r in x.tolist()] for x in got] == [plain_runs(d) for d in docs]


def test_range_minima_and_next_smaller():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 8, 9, 64, 100):
        v = rng.integers(0, 9, n)
        first = rng.integers(0, n, 50)
        last = np.array([rng.integers(a, n) for a in first])
        assert runs.RangeMinima(v)(first, last).tolist() == [v[a : b + 1].min() for a, b in zip(first, last)]
        assert runs.next_smaller(v).tolist() == [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(n)]


def plain_report(i, text):
    w = WORDS.findall(text or "")
    at = runs.planted(i, len(w))
    w = w if at is None else [w[k] for k in at]
    found = plain_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_the_given_documents(spark):
    """The whole small table, which holds documents made periodic by their ids."""
    got = {tuple(r) for r in runs.op12_runs(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == {plain_report(r.doc_id, r.text) for r in rows} and any(r[1] for r in got)


def test_runs_of_awkward_tables(spark, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    rows = [(1, None), (2, ""), (None, "a b " * 9), (3, "z " * 5), (3, "z " * 6), (3, "z " * 6), (4, "a a b " * 30_000), (5, "x y " * 8), (6, "Ä \U0001f600 " * 4)]
    docs = documents(spark, rows).withColumn("runs", F.lit(1)).withColumn("start", F.lit("x"))
    assert sorted(map(repr, map(tuple, runs.run_reports(docs.filter("doc_id <> 4 or doc_id is null"), runs.planted).collect()))) == sorted(repr(plain_report(*r)) for r in rows if r[0] != 4)
    assert runs.run_reports(docs.filter("false")).count() == 0
    out = {r.doc_id: r for r in runs.collapse(docs.filter("doc_id in (4, 5)")).collect()}
    assert out[5].text == "x y" and out[4].text == "a a b" and [tuple(r) for r in out[4].runs] == [(0, 90_000, 3)]


# ---- 13 ----


def plain_negatives(rows, anchors, share=(80, 100), k=5):
    """rows, anchors: (id, label, list of integers)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in anchors:
        score = sorted(((-dot(v, x), j, y) for j, y, x in rows if j != i))
        for s, p in [(-s, j) for s, j, y in score if y == label][:k]:
            fits = [(j, -n) for n, j, y in score if y != label and share[0] * s <= -100 * n <= share[1] * s]
            out += [(i, p, r, j, s, n) for r, (j, n) in enumerate(fits[:k], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, id string, v int"


def test_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "MAX_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "MAX_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "CHUNK", 300)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 12))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 3] + 0.7 * rng.normal(size=12)], int(i % 3 + (i % 11 == 0))) for i in rng.permutation(400)]
    rows += [(i, [0.5] * 12, i % 2) for i in range(1000, 1100)]  # ties
    rows += [(2000, None, 1), (2001, [1.0, float("nan")], 1), (2002, [1.0, None], 1), (2003, [float("inf")], 1), (2004, [1.0], None), (None, [1.0], 1), (2005, [], 1), (2006, [1.0] * 15, 0), (2007, [3e38], 1)]
    rows += [(7, rows[0][1], -5)]  # the least label of a repeated id counts
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    best = {}
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v):
            x = (y, [int(np.floor(max(min(256 * float(np.float32(c)), hard_negatives.LIMIT), -hard_negatives.LIMIT))) for c in v])
            best[i] = min(best.get(i, x), x)
    plain = [(i, y, v) for i, (y, v) in best.items()]
    clean = hard_negatives.clean(df)
    assert sorted((r.id, r.label, list(r.v)) for r in clean.collect()) == sorted(plain)
    got = hard_negatives.hard_negatives(clean, clean.filter("id % 9 = 0"))
    want = plain_negatives(plain, [x for x in plain if x[0] % 9 == 0])
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 300


def test_negatives_of_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "x", 1), (1, [1.0], 1, "x", 1), (2, [0.9], 2, "x", 1), (3, [0.1], 2, "x", 1)], VECTORS)
    rows = hard_negatives.clean(df)
    assert hard_negatives.hard_negatives(rows.filter("false"), rows.filter("false")).count() == 0
    assert hard_negatives.hard_negatives(rows, rows.filter("false")).count() == 0
    assert hard_negatives.hard_negatives(rows.filter("id = 0"), rows.filter("id = 0")).count() == 0
    assert [tuple(r) for r in hard_negatives.hard_negatives(rows, rows.filter("id = 0")).collect()] == [(0, 1, 1, 2, 256 * 256, 256 * 230)]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, (200, 6))
    borders = np.quantile(v[:20], np.arange(1, hard_negatives.CELLS) / hard_negatives.CELLS, axis=0, method="nearest").T.astype(np.int64)
    packed = hard_negatives._packed(np.arange(200), np.zeros(200, np.int64), v, borders, 0)
    block = hard_negatives._Block(dict(zip(("part", "dims", "ids", "labels", "cells", "vectors"), packed)))
    low, high = hard_negatives._bounds(block, np.arange(200), v[:9], block.edges(borders))
    exact = v @ v[:9].T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 0.6 * (exact.max() - exact.min())


def test_file_of_blocks(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 3, "x", 1) for i in range(100)], VECTORS)
    rows = hard_negatives.clean(df).coalesce(1)
    held = hard_negatives.blocks(rows, 1, np.zeros((1, hard_negatives.CELLS - 1), np.int64), 30, 4).collect()
    ids = defaultdict(int)
    for r in held:
        for i in r.ids:
            ids[i] += 1
    assert len(ids) == 100 and set(ids.values()) == {1} and max(len(r.ids) for r in held) <= 30
