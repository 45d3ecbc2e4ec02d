"""Operators against brute force, exact round trips and awkward tables."""

import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchweave.llm import chat, exact_dedup, mixing, packing, topk_search, toxicity, warc
from patchweave.operators import hot_keys

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


ODD = [(1, None, "b"), (2, "", None), (3, " \t\n", "a"), (4, "one", "a"), (5, "one", "a"), (5, "one", "a"), (6, "ONE", "é"), (7, "word " * 30_000, "b"), (None, "no id", "b"), (None, "no id", "b"), (9, "Ä ä \U0001f600 x", None)]


# ---- 1 ----


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 4 <> 0"))
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    got = toxicity.add_severity(docs.join(labels.filter("doc_id % 4 = 0"), "doc_id").select("doc_id", "text", F.col("toxic").alias("label")), model).collect()
    hit = Counter((r.label, r.toxic) for r in got)
    assert hit[1, True] >= 0.85 * (hit[1, True] + hit[1, False]) and hit[0, True] <= 0.01 * (hit[0, True] + hit[0, False]), hit
    mean = lambda y: sum(r.expected_severity for r in got if r.label == y) / sum(r.label == y for r in got)
    assert mean(1) > 1 > 0.3 > mean(0)


def test_toxicity_edge_cases(spark):
    docs = documents(spark, ODD).withColumn("toxic", F.lit(5)).withColumn("expected_severity", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.keep_rows(docs, none).count() == len(ODD)
    assert toxicity.keep_rows(docs, spark.createDataFrame([(1, 1, 1), (1, 0, None), (None, 1, 1)], none.schema)).columns == docs.columns
    labels = spark.createDataFrame([(4, 0, 1), (7, 1, 0), (2, None, 0)], none.schema)
    assert toxicity.train(docs.filter("false"), labels).thresholds == []
    toxicity.add_severity(docs.select("doc_id", "text"), toxicity.train(docs, labels)).collect()


# ---- 2 ----


def plain_targets(sizes, weights):
    total, capped = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(3 * sizes[i] for i in capped)
        out = {i: left * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        over = {i for i in free if out[i] > 3 * sizes[i] + 1e-9}
        if not over:
            return [3.0 * sizes[i] if i in capped else out[i] for i in range(len(sizes))]
        capped |= over


def test_targets():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        sizes, weights = [rng.choice([0, 1, 10, 1000, rng.randint(1, 10**6)]) for _ in range(n)], [1.0 + i % 3 for i in range(n)]
        assert mixing.targets(sizes, weights) == pytest.approx(plain_targets(sizes, weights))


def test_clashing_columns_of_mixing_and_packing(spark):
    """Columns of the given table that are named like results change nothing."""
    docs = documents(spark, ODD)
    more = docs
    for c in ("size", "target", "taken", "shard", "position", "words", "start", "ids", "sequence_id", "offset", "length", "doc_tokens"):
        more = more.withColumn(c, F.lit("x"))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(mixing.report(more)) == plain(mixing.report(docs))
    mixed = mixing.mixed_rows(more)
    assert mixed.columns == more.columns and {r.size for r in mixed.collect()} == {"x"}
    assert sorted((str(r.doc_id), r.text) for r in mixed.collect()) == sorted((str(r.doc_id), r.text) for r in mixing.mixed_rows(docs).collect())
    tokens = lambda df: Counter((r.doc_id, r.doc_tokens) for r in packing.pack(df).collect())
    assert tokens(more) == tokens(docs)


def test_splitting_tree_is_exact_and_disjoint():
    quotas = np.array([7, 0, 1000, 35, 10**6], np.int64)
    parts = list(mixing.split_quotas(quotas, 13, 0, 13))
    assert [p[0] for p in parts] == list(range(13))
    at = np.zeros_like(quotas)
    for _, starts, counts in parts:
        assert (starts == at).all() and (counts >= 0).all()
        at = at + counts
    assert (at == quotas).all()
    again = list(mixing.split_quotas(quotas, 13, 5, 7))
    assert [(a[0], *a[1], *a[2]) for a in again] == [(p[0], *p[1], *p[2]) for p in parts[5:7]]
    assert max(int(p[2].sum()) for p in parts) - min(int(p[2].sum()) for p in parts) <= 1


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_BLOCKS", 16)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = given.unionByName(documents(spark, [(k and k + 10_000, t, s) for k, t, s in ODD]))
    rows = mixing.report(docs).collect()
    assert len(rows) == docs.count()
    source = defaultdict(list)
    for r in rows:
        source[r.source_size, r.target].append(r)
        assert r.taken <= 3 * r.size
    for (size, target), rs in source.items():
        assert sum(r.size for r in rs) == size and abs(sum(r.taken for r in rs) - target) <= 1
    again = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.report(docs).collect())
    assert again == sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    _, slots = mixing.plan(docs, shard_words=2_000)
    got = slots.collect()
    assert len({(r.shard, r.position) for r in got}) == len(got)
    assert sum(r.words for r in got) == sum(r.taken for r in rows)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.taken
    assert +words == +want
    assert mixing.report(docs.filter("false")).count() == 0 and mixing.mixed_rows(docs.filter("false")).count() == 0


def test_mixing_puts_out_what_was_dealt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_SLOTS", 16)
    rng = random.Random(7)
    docs = documents(spark, [(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([5, 300, 2_500]))), rng.choice("abc")) for i in range(120)])
    _, slots = mixing.plan(docs, shard_words=15_000)
    slots = slots.collect()
    shards = defaultdict(list)
    for r in slots:
        shards[r.shard].append(r.position)
    assert len(shards) > 3 and all(sorted(p) == list(range(len(p))) for p in shards.values())
    dealt = defaultdict(list)
    for r in slots:
        dealt[r.doc_id].append(r)
    for r in mixing.report(docs, shard_words=15_000).collect():
        of = dealt[r.doc_id]
        assert (r.first_shard, r.n_shards) == (min((x.shard for x in of), default=None), len({x.shard for x in of}))
        assert (r.positions_hash is None) == (not of)
    firsts = {}
    for r in slots:
        at = (r.shard, r.epoch, r.doc_id)
        firsts[at] = min(firsts.get(at, (r.shard, r.position)), (r.shard, r.position))
    want = [at[2] for at in sorted(firsts, key=firsts.get)]
    assert [r.doc_id for r in mixing.mixed_rows(docs, shard_words=15_000).collect()] == want


def test_draws_beyond_numpy(monkeypatch):
    """By inversion the draws have the distribution of numpy's, and hold at sizes that numpy refuses."""
    rng = np.random.default_rng(4)
    plain = Counter(int(rng.hypergeometric(30, 50, 20)) for _ in range(20_000))
    monkeypatch.setattr(mixing, "NUMPY_RANGE", 0)
    other = Counter(mixing._hypergeometric(rng, 30, 50, 20) for _ in range(20_000))
    assert all(abs(plain[k] - other[k]) < 6 * math.sqrt(plain[k] + 10) for k in range(21))
    assert [mixing._hypergeometric(rng, g, b, n) for g, b, n in ((5, 0, 3), (0, 5, 3), (5, 5, 10), (1, 10**12, 0))] == [3, 0, 5, 0]
    x = [mixing._hypergeometric(rng, 4 * 10**9, 6 * 10**9, 5 * 10**9) for _ in range(40)]
    assert abs(np.mean(x) - 2 * 10**9) < 6 * 24_495 / math.sqrt(40) and 12_000 < np.std(x) < 50_000


def test_more_sources_than_the_cap(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([3, 40, 3_000]))), rng.choice([None, "", "b", "a", "é", "zz", "c", "d", "e"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BUCKET_BLOCKS", 16)
    few = {r.doc_id: (r.size, r.source_size, r.target) for r in mixing.report(docs, shard_words=20_000).collect()}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 4)
    many = mixing.report(docs, shard_words=20_000).collect()
    assert {r.doc_id: (r.size, r.source_size) for r in many} == {k: v[:2] for k, v in few.items()}
    assert all(r.target == pytest.approx(few[r.doc_id][2]) and r.taken <= 3 * r.size for r in many)
    source = {i: s for i, _, s in rows}
    for s in set(source.values()):
        assert abs(sum(r.taken for r in many if source[r.doc_id] == s) - next(r.target for r in many if source[r.doc_id] == s)) <= 1
    _, slots = mixing.plan(docs, shard_words=20_000)
    places = [(r.shard, r.position) for r in slots.collect()]
    assert len(set(places)) == len(places) and len({p[0] for p in places}) > 2
    assert sorted(places) == [(s, p) for s in sorted({p[0] for p in places}) for p in range(sum(1 for q in places if q[0] == s))]


def test_mixing_draws_at_the_given_scale(spark):
    """With the production parameters: shards of nearly equal size, whose sources are near their shares, as drawn."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, slots = mixing.plan(docs)
    got = slots.groupBy("shard", "source").count().collect()
    per, of = Counter(), Counter()
    for r in got:
        per[r.shard] += r["count"]
        of[r.source] += r["count"]
    assert len(per) == mixing.LEAST_SHARDS and max(per.values()) - min(per.values()) <= 1
    n, most = sum(per.values()), max(of, key=of.get)
    drawn = [r["count"] for r in got if r.source == most]
    spread, share = np.var(drawn), of[most] / n
    k = n / len(per)
    assert 0.4 < spread / (k * share * (1 - share)) < 2.5  # a hypergeometric draw's, not an even deal's
    shards = [r.n_shards for r in mixing.report(docs).collect()]
    assert max(shards) > 1


def test_mixing_tells_texts_apart_that_share_id_and_size(spark):
    texts = ["one two three", "four five six", "seven eight nine", "one two three", "b c", "d e"]
    docs = documents(spark, [(None if len(t) > 3 else 4, t, "a") for t in texts])
    assert sorted(r.text for r in mixing.mixed_rows(docs).collect()) == sorted(texts)  # a single source is taken once, whole
    assert [(r.size, r.taken) for r in mixing.report(docs).orderBy("size").collect()] == [(2, 2)] * 2 + [(3, 3)] * 4


# ---- 4 ----


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(20_001, "İx ẞ. ΑΣ, <|endoftext|>a\x1cb don't 1.5"), (20_002, "w" * 3_000), (20_003, "क़. é́,"), *((k and 10_000 + k, t) for k, t, _ in ODD)]
    docs = given.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).repartition(3)
    pieces = packing.pack(docs).collect()
    whole = defaultdict(list)
    for r in docs.collect():
        whole[r.doc_id].append(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    made, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        made[p.doc_id].append((p.start, bytes(p.ids), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, texts in whole.items():
        if len(texts) == 1:
            assert b"".join(x for _, x, _ in sorted(made[i])) == texts[0] and {n for *_, n in made[i]} == {len(texts[0]) // 4}
        assert sum(len(x) for _, x, _ in made[i]) == sum(map(len, texts))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # nothing is padded
    digest = packing.digests(packing.pack(docs.filter("doc_id = 20002"))).collect()
    assert [r.ids_crc32 for r in digest] == [zlib.crc32(b) for b in [bytes(p.ids) for p in packing.pack(docs.filter("doc_id = 20002")).collect()]]
    assert packing.pack(docs.filter("false")).count() == 0


# ---- 5 ----


def test_arc_versions_and_broken_archives(spark):
    records = [("http://a/é b", "text/html", b"HTTP/1.1 200 OK\r\nX-Record-Key: -3\r\n\r\npay\r\n\r\nload"), ("dns:a", "text/dns", b"1.2.3.4"), ("http://b", "text/html", b"")]
    for version in (1, 2):
        data = warc.write_arc("x.arc", version, records)
        got = list(warc.read_arc(data))
        assert [b for _, _, b in got[1:]] == [b for *_, b in records] and got[1][1]["URL"] == "http://a/é%20b"
    df = spark.createDataFrame([("ok", bytearray(data)), ("cut", bytearray(data[:-5])), ("junk", bytearray(b"nothing")), ("empty", None)], "archive string, content binary")
    rows = warc.arc_to_records(df).collect()
    kinds = Counter((r.archive, r.record_type) for r in rows)
    assert kinds == {("ok", "warcinfo"): 1, ("ok", "response"): 1, ("ok", "resource"): 2, ("cut", "warcinfo"): 1, ("cut", "response"): 1, ("cut", "resource"): 1, ("cut", "error"): 1, ("junk", "error"): 1}
    r = next(r for r in rows if r.record_type == "response")
    assert bytes(r.payload) == b"pay\r\n\r\nload" and r.record_key == -3 and r.payload_digest == warc.b32_sha1(b"pay\r\n\r\nload")
    body = warc.warc_record({**r.asDict(), "refers_to": None})
    (fields, block), = warc.parse_warc(io.BytesIO(body + b"\r\n\r\n"))
    assert fields["warc-type"] == "response" and block.endswith(b"pay\r\n\r\nload")
    assert len(list(warc._read(gzip.compress(body + b"\r\n\r\n" + body)))) == 2


@pytest.mark.parametrize("least_hot", [1, 100])
def test_pages(spark, tmp_path, monkeypatch, least_hot):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", least_hot)
    rows = [(5, "u", "same"), (3, "u", "same"), (9, None, None), (8, "v", ""), (1, "w w", "\r\n\r\nWARC/1.1\r\n"), (4, "x", "é" * 50_000), (None, "y", "same"), (None, "y", "alone"), (6, "z", "t"), (6, "z", "t")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_key", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op5_arc_to_warc(spark, str(tmp_path)).collect())
    d = lambda t: (len((t or "").encode()), warc.b32_sha1((t or "").encode()))
    kind = {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 8), 8: ("response", None), 1: ("response", None), 4: ("response", None), 6: ("response", None)}
    want = Counter((i, *d(h), *(kind[i] if i is not None else ("revisit", 3) if h == "same" else ("response", None))) for i, _, h in rows)
    assert got == want
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op5_arc_to_warc(spark, f"{tmp_path}/none").count() == 0


def test_one_large_record_does_not_make_a_file_of_each(spark, tmp_path, monkeypatch):
    """FILE_BYTES is a constant of the driver, CHUNK_BYTES of the tasks: 4 MB. The large page is one file, the others fill chunks."""
    monkeypatch.setattr(warc, "FILE_BYTES", 5 << 20)
    rows = spark.range(0, 3_000, 1, 1).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "CASE WHEN id = 1500 THEN repeat('big ', 1500000) ELSE concat(id, repeat(' y', 2000)) END AS html")
    records = warc.arc_to_records(warc.pages_to_arc(rows))
    path = f"{tmp_path}/warc"
    warc.write_warc(records.withColumn("refers_to", F.lit(None).cast("long")), path)
    files = list(Path(path).glob("part-*"))
    assert 4 <= len(files) <= 8, len(files)
    got = warc.read_warc(spark, path).filter("record_type = 'response'").agg(F.count_distinct("record_key"), F.sum("payload_bytes"), F.min(F.col("intact").cast("int"))).first()
    assert tuple(got) == (3_000, sum(len(f"{i}") + 4_000 for i in range(3_000) if i != 1_500) + 6_000_000, 1)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4_000)
    spark.createDataFrame([(i, f"http://x/{i}", "y" * (5_000 if i == 3 else 10)) for i in range(6)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    rows = warc.op5_arc_to_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in rows) == [(i, 5_000 if i == 3 else 10, "response" if i in (0, 3) else "revisit") for i in range(6)]


# ---- 8 ----


def test_topk(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(300)] + [(i, [1.0] * 64) for i in range(300, 420)] + [(500, None), (None, [1.0] * 64), (501, []), (502, [None] * 64), (503, [1.0] * 130)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("code", F.lit(1))
    ids = [0, 20, 300, 320, 500, 501]
    got = defaultdict(list)
    for r in topk_search.top_k(df, df.filter(F.col("vec_id").isin(ids)), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.neighbor_id, r.distance))

    def code(v):
        return [sum(x or 0 for x in v[i::64]) > 0 for i in range(64)]

    codes = {i: code(v) for i, v in vectors if i is not None and v is not None}
    for q in (i for i in ids if i in codes):
        want = sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in codes.items() if i != q)[:10]
        assert got[q] == [(i, d) for d, i in want], q
    assert 500 not in got
    few = df.filter("vec_id < 3")
    assert topk_search.top_k(few, few, 10).count() == 6 and topk_search.top_k(few.filter("false"), few.filter("false")).count() == 0


def test_topk_with_a_hot_segment(spark, monkeypatch):
    """Most codes share a segment's value, so that it is split into pieces; results stay exact."""
    monkeypatch.setattr(topk_search, "BUCKET_CODES", 16)
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (400, 64))
    bits[:300, :32] = 1
    df = spark.createDataFrame([(i, [float(2 * b - 1) for b in row]) for i, row in enumerate(bits)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk_search.top_k(df, df.filter("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
    for q in range(0, 400, 20):
        far = (bits != bits[q]).sum(1)
        assert got[q] == sorted((int(far[i]), i) for i in range(400) if i != q)[:5]


# ---- 9 ----


def test_counting_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(4)
    for q in (0, 3, 8):
        parts = [rng.integers(0, 500, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(5)]
        f = exact_dedup.CountingQuotientFilter.build(q, parts[0])
        for p in parts[1:]:
            f = f.merge(exact_dedup.CountingQuotientFilter.build(q, p))
        want = Counter(np.concatenate(parts).tolist())
        assert dict(zip(f.fingerprints().tolist(), f.counts.tolist())) == want
        back = {}
        for quotient, data in f.blocks():
            g = exact_dedup.CountingQuotientFilter.read(q, quotient, data)
            back |= dict(zip(g.fingerprints().tolist(), g.counts.tolist()))
        assert back == want


@pytest.mark.parametrize("limit", [1_000_000, -1])
def test_exact_dedup(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_IDS", limit)
    docs = documents(spark, [*ODD, (20, "ÉONE", "c"), (21, "éone", "c"), (22, "Word " * 30_000, "c")]).withColumn("keep_id", F.lit(0))
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[low(r.text)].append(r.doc_id)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == want
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(low(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(docs.filter("false")).count() == 0 and exact_dedup.keep_rows(docs.filter("false")).count() == 0


# ---- 10 ----


def test_chat_round_trip():
    rng = random.Random(8)
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "/s>", "[", "INST]", "a", "\n", "é", "\U0001f600", ""]
    for _ in range(2_000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[/ROLE]x\\"]), "".join(rng.choices(bits, k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 4))]
        text = "".join(chat.round_trip(*t)[0] for t in turns)
        assert list(chat.parse([text])) == turns
        cut = sorted(rng.choices(range(len(text) + 1), k=3))
        assert list(chat.parse([text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])])) == turns
    for bad in ("x", "[INST]a", "[INST]<s>[/INST]", "</s>", "[INST]a[/INST]x"):
        with pytest.raises(chat.GrammarError):
            list(chat.parse([bad]))


def test_chat_tables(spark, tmp_path):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", None), (None, 0, "user", "x"), (None, None, None, "y"), (2, 0, "assistant", "z" * 200_000), (2, 0, "assistant", "z" * 200_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op10_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\n\nassistant\nb </s>\n"), 6, sha("b </s>"))
    assert got[None].n_turns == 2 and got[None].turns_sha256 == sha("\ny\nuser\nx\n")
    assert got[2].loss_chars == 400_000 and set(got) == {1, 2, None, -7}
    assert got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and math.isclose(got[-7].n_turns, 2)


def test_chat_ties_of_turn_are_ordered_by_role_and_text(spark, tmp_path):
    """One conversation holds most rows; empty and null roles and texts tie, and escaping doesn't change the order."""
    rng = random.Random(5)
    texts = [None, "", "<s>", "<s", "<", "[INST]", "[INSTx", "\\", "a\\b", "é", "z" * 5_000]
    rows = [(rng.choice([7] * 8 + [None, 8]), rng.choice([None, 0, 1, 2]), rng.choice([None, "", "user", "assistant", "tool"]), rng.choice(texts)) for _ in range(3_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op10_chat_format(spark, str(tmp_path)).collect()}
    for conv in (7, 8, None):
        turns = sorted((-1 if t is None else t, (r or "").encode(), (x or "").encode()) for c, t, r, x in rows if c == conv)
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, r, x in turns)).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(b"".join(x for _, r, x in turns if r == b"assistant")).hexdigest()


def test_chat_parser_reads_each_character_once():
    parser, text = chat.Parser(), "x" * 20_000
    turns = [t for c in "[INST]" + text + "[/INST]" for t in parser.feed(c)]
    assert turns == [("user", text)] and not parser.held
    with pytest.raises(chat.GrammarError):
        list(parser.feed("y"))


def test_chat_loss_is_read_under_the_mask(spark):
    text = "</s>\\ yes"
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(turns)
    digest = lambda x: (len(x), hashlib.sha256(x.encode()).hexdigest())
    (r,) = chat.read_back(segments).collect()
    assert (r.loss_chars, r.loss_sha256) == digest(text)
    (r,) = chat.read_back(segments.withColumn("loss_end", F.col("loss_end") - 1)).collect()
    assert (r.loss_chars, r.loss_sha256) == digest(text[:-1])
