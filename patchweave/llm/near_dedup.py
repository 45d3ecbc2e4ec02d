"""MinHash near-deduplication: universal hash minima, banding, verification, large-star and small-star components.

A document's set is its distinct shingles of five words (fewer words: the whole sequence). Documents with equal sets
are one class; a class is represented by its smallest doc_id. Links are pairs of classes with 100 * intersection >= 75
* union, counted on the full sets; MinHash only proposes candidates.

Candidates without all pairs of a bucket: in each bucket of a band every class is compared with the bucket's smallest
class and with its most central one, that with the most bucket mates over all bands. Signatures rule out what is far
from the threshold, full sets decide the rest, and components are built. A bucket whose classes now lie in one
component can add nothing. In the other buckets classes of different components are compared with each other, where
exact counts leave room for a link: a shingle that no other set in those buckets has can't be common, and what two
sets share within the central one is at most what either shares with it. So no pair of a bucket that could join two
components is skipped, and a bucket of many near copies costs as many comparisons as it has classes.

Chance of a miss: a pair at the threshold shares a band of 7 minima with probability 0.133, so all 64 bands miss it
with 1e-4 (3e-7 at a similarity of 0.8); its estimate from 128 minima lies below SKIP_BELOW, 5 standard deviations
off, with 3e-7. Long bands keep documents apart that share a passage only.

Defined results: null and empty texts, and texts of white space alone, have no shingles and link with nothing; rows
repeated with the same doc_id share one verdict; rows without doc_id join their class but never represent it, are
dropped or kept by their class, and a class of such rows alone has a null component_id and stays; texts of any length are read whole; an empty table gives
an empty result; further columns are ignored by the report and kept by keep_rows().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from patchweave.llm.common import documents, drop_table, with_ids, write_table
from patchweave.operators.hot_keys import join_counted

SHINGLE = 5
BANDS, ROWS = 64, 7
MINIMA = BANDS * ROWS
#: Minima that are kept for the estimate of a pair's similarity.
KEPT = 128
#: In hundredths: the similarity from which documents are linked.
LINK = 75
#: Pairs whose signatures agree in a smaller share of their minima are not verified.
SKIP_BELOW = 0.56

_RNG = np.random.default_rng(20_240_101)
_BASE = np.uint64(int(_RNG.integers(1 << 62)) * 4 + 3)
_MULTIPLIERS = _RNG.integers(1 << 63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1 << 31, size=MINIMA, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(1 << 32, size=MINIMA, dtype=np.uint64).astype(np.uint32)
_BAND = _RNG.integers(1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers with good avalanche (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))
        return self.up, self.down


_POWERS = _Powers()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    data = (text or "").encode().lower()
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64)
    edges = np.flatnonzero(np.diff(np.r_[True, _SPACE[buf], True]))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.of(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    if n < SHINGLE:
        return _mix(np.array([(words * _MULTIPLIERS[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = words[: n - SHINGLE + 1] * _MULTIPLIERS[0]
    for k in range(1, SHINGLE):
        total = total + words[k : n - SHINGLE + 1 + k] * _MULTIPLIERS[k]
    return np.unique(_mix(total))


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a * x + b over the set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1_024):
        block = _A[:, None] * x[None, k : k + 1_024]
        block += _B[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of minima."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _set_key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, keys, signatures, bands = [], [], [], []
        for t in b.column("text").to_pylist():
            s = shingles(t)
            counts.append(len(s))
            keys.append(_set_key(s))
            least = minima(s) if len(s) else None
            signatures.append(None if least is None else least[:KEPT].tobytes())
            bands.append(None if least is None else band_keys(least).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature", "bands"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], names=["bucket", "node"])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, KEPT) for c in ("sig_a", "sig_b"))
            near = pa.array((x == y).mean(axis=1) >= SKIP_BELOW)
            yield b.select(["a", "b"]).filter(near)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["node", "members"])


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        linked = []
        for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = _shared(x, y)
            linked.append(100 * common >= LINK * (len(x) + len(y) - common))
        yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for node, data in zip(b.column("node").to_pylist(), b.column("members").to_pylist(), strict=True):
            values = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), node))], names=["shingle", "node"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [_shared(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("central"), b.column("node"), pa.array(sizes, pa.int64())], names=["central", "node", "common"])


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node and members (its shingles) for the classes in ids, a written table with doc_id."""
    return write_table(with_ids(docs, ids).mapInArrow(_sets, "node long, members binary"), "op6-sets")


def _private(sets: DataFrame) -> DataFrame:
    """node, n (size of its set) and own: how many of its shingles no other set of the table has."""
    single = sets.mapInArrow(_members, "shingle long, node long").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).filter("df = 1")
    own = single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("node", (F.octet_length("members") / 8).cast("long").alias("n")).distinct()
    return sizes.join(own, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).cast("long").alias("own"))


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Of candidate pairs (a, b), a written table, those that are linked. sets: where they are known already."""
    sig = nodes.select("node", "signature")
    near = pairs.join(sig.withColumnsRenamed({"node": "a", "signature": "sig_a"}), "a").join(sig.withColumnsRenamed({"node": "b", "signature": "sig_b"}), "b")
    near = write_table(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimate, "a long, b long"), "op6-near")
    if sets is None:
        ids = write_table(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "op6-ids")
        sets = _sets_of(docs, ids)
    both = near.join(sets.withColumnsRenamed({"node": "b", "members": "set_b"}), "b").join(sets.withColumnsRenamed({"node": "a", "members": "set_a"}), "a")
    out = write_table(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a long, b long").distinct(), "op6-links")
    drop_table(near)
    drop_table(sets)
    return out


def components(links: DataFrame, tag: str = "op6-stars") -> DataFrame:
    """(node, root) for each node of links (a, b) that isn't the smallest of its component, by alternating large-star and small-star.

    A node of many edges, such as a component's centre, is broadcast with its least neighbour; its edges stay where they are."""
    state = lambda t: t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
    edges = write_table(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    before = state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.filter("v > u"), least, "u", "n", 2 * before[0])
        large = write_table(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tag)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, lowest, "u", "n", before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        done = write_table(small, tag)
        drop_table(edges)
        drop_table(large)
        after, edges = state(done), done
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_groups(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept."""
    return _verdicts(docs).drop("set_key")


def _verdicts(docs: DataFrame) -> DataFrame:
    """near_groups() with set_key, which equal sets share; null where a text has no shingles."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketch = write_table(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, signature binary, bands binary"), "op6-sketch")
    classes = write_table(sketch.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min("signature").alias("signature"), F.min("bands").alias("bands")), "op6-classes")
    nodes = classes.filter("node is not null")

    all_buckets = nodes.select("node", "bands").mapInArrow(_bands, "bucket long, node long")
    shared = all_buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = write_table(all_buckets.join(shared, "bucket"), "op6-members")
    # The class with the most bucket mates, as the original of many edited copies has, is the one to compare with.
    mates = members.groupBy("node").agg(F.sum("size").alias("mates"))
    ends = members.join(mates, "node").groupBy("bucket").agg(F.min("node").alias("low"), F.max_by("node", "mates").alias("central"))
    buckets = write_table(members.drop("size").join(ends, "bucket"), "op6-buckets")
    stars = buckets.select(F.explode(F.array("low", "central")).alias("x"), "node").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
    tried = write_table(stars.filter("a < b").distinct(), "op6-tried")
    links = _links(docs, nodes, tried)

    # Buckets that still hold several components: their classes are compared across components.
    roots = components(links)
    held = buckets.select("bucket", "central", "node").join(roots, "node", "left").select("bucket", "central", "node", F.coalesce("root", "node").alias("root"))
    mixed = held.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("bucket")
    held = write_table(held.join(mixed, "bucket"), "op6-mixed")
    sets = _sets_of(docs, write_table(held.select(F.col("node").alias("doc_id")).distinct(), "op6-ids"))
    # Upper bounds of what two sets share: shingles that no other set here has are left out; of the rest, what lies in
    # the bucket's central set is bounded by what either shares with that one.
    spokes = held.select("central", "node").distinct().join(sets.withColumnsRenamed({"members": "set_a"}), "node").join(sets.withColumnsRenamed({"node": "central", "members": "set_b"}), "central")
    spokes = spokes.select("central", "node", "set_a", "set_b").mapInArrow(_common, "central long, node long, common long").distinct()
    held = write_table(held.join(_private(sets), "node").join(spokes, ["central", "node"]), "op6-bounded")
    left, right = (held.select("bucket", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("root", "n", "own", "common"))) for x in "ab")
    outside = lambda x: F.greatest(F.lit(0), F.col(f"n_{x}") - F.col(f"common_{x}") - F.col(f"own_{x}"))
    most = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"), F.least("common_a", "common_b") + F.least(outside("a"), outside("b")))
    possible = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (100 * most >= LINK * (F.col("n_a") + F.col("n_b") - most))
    across = left.withColumnRenamed("bucket", "bucket_a").join(right, (F.col("bucket_a") == F.col("bucket")) & possible).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    across = write_table(across, "op6-across")
    if across.limit(1).count():
        more = _links(docs, nodes, across, sets)
        if more.limit(1).count():
            roots = components(links.union(more))

    joined = classes.join(roots, "node", "left").filter("n > 1 or root is not null").select("set_key", F.coalesce("root", "node").alias("component"), F.lit(True).alias("grouped"))
    return sketch.join(joined, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("grouped"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("grouped"), F.col("doc_id").eqNullSafe(F.col("component"))).otherwise(True).alias("kept"),
        "set_key",
    )


def keep_rows(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, all columns."""
    dropped = write_table(_verdicts(docs).filter("not kept").select("doc_id", "set_key"), "op6-dropped")
    out = with_ids(docs, dropped.filter("doc_id is not null").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "left_anti")
    nameless = dropped.filter("doc_id is null").select(F.col("set_key").alias("__set_key")).distinct()
    if not nameless.limit(1).count():
        return out

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([_set_key(shingles(t)) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*b.schema.names, "__set_key"])

    # Rows without doc_id are decided by their sets.
    tagged = docs.filter("doc_id is null").mapInArrow(tag, StructType([*docs.schema.fields, StructField("__set_key", BinaryType())]))
    return out.filter("doc_id is not null").unionByName(tagged.join(nameless, "__set_key", "left_anti").select(docs.columns))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
