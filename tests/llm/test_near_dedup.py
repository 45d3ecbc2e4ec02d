"""Components against all pairs on small tables."""

import random
import re

from patchweave.llm import near_dedup as N
from patchweave.operators import hot_keys


def plain_sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_components(rows):
    sets = {i: plain_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owners = {}
    for i, s in sets.items():
        for g in s:
            owners.setdefault(g, []).append(i)
    pairs = {(a, b) for o in owners.values() for a in o for b in o if a < b}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows, schema="doc_id long, text string"):
    got = {r.doc_id: r for r in N.near_groups(spark.createDataFrame(rows, schema)).collect()}
    for i, (n, c) in plain_components([r[:2] for r in rows]).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c), i


def test_chains_copies_and_odd_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b c"), (5, "a B\tc"), (6, "a b c d"), (7, "x y z"), (8, "x y z")]
    base = [word() for _ in range(120)]
    for k in range(60):  # near copies, each with edits of its own
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(120)] = word()
        rows.append((100 + k, " ".join(copy)))
    chain = [word() for _ in range(100)]
    for k in range(20):  # each close to the next, the ends far apart
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((300 + k, " ".join(chain)))
    passage = [word() for _ in range(60)]
    rows += [(400 + k, " ".join([*passage, *(word() for _ in range(rng.choice([5, 15, 20, 25, 60])))])) for k in range(40)]
    rows.append((500, " ".join(base * 400)))
    rows.append((501, "one " * 50_000))
    rng.shuffle(rows)
    check(spark, rows)


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows])


def test_empty_null_ids_and_extra_columns(spark):
    assert N.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 2), (None, "only here it is", 3), (9, "q", 4), (9, "q", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in N.near_groups(df).collect())
    assert got == sorted([("None", 2, 3, False), ("3", 2, 3, True), ("None", 1, None, True), ("9", 1, 9, True), ("9", 1, 9, True)])
    assert N.keep_rows(df.filter("doc_id is not null")).columns == df.columns


def test_rows_without_id_are_kept_by_their_sets(spark):
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 2), (None, "only here it is", 3), (9, "q", 4), (9, "q", 4), (None, None, 5), (None, " ", 6), (None, "A b c d e f", 7), (None, "another one", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = N.keep_rows(df)
    assert kept.columns == df.columns
    assert sorted(r.component_id for r in kept.collect()) == [2, 3, 4, 4, 5, 6, 8]


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 10)
    rng = random.Random(9)
    links = [(rng.randrange(100), rng.randrange(100)) for _ in range(40)] + [(1_000 + k, 1_000) for k in range(60)] + [(1_000 + k, 2_000 + k) for k in range(20)] + [(3_001 + k, 3_000 + k) for k in range(15)]
    root = {n: n for e in links for n in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
