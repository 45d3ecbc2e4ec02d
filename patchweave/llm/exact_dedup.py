"""Exact deduplication with counting quotient filters.

Each partition builds a counting quotient filter of its 64-bit fingerprints: the quotient (high bits) picks a slot, the
remainder (low bits) is stored in it, sorted, with a count. Quotient and remainder give back the whole fingerprint, so
filters merge without loss by merging sorted remainders. A filter is cut into blocks of quotients; the blocks of all
partitions meet by a shuffle. Only fingerprints with a count above one go on to a comparison of the bytes themselves.

Texts are equal when they are identical after lower-casing A-Z. Of equal texts the row with the largest doc_id stays.

Defined results: a null text counts as empty, and empty texts are equal; rows repeated with the same doc_id and text
share one verdict in the report, and keep_rows() leaves one of them; a null doc_id counts as smallest (a group of
nulls only keeps a null); an empty table gives an empty result; further columns are ignored by the report and kept
by keep_rows().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from patchweave.llm.common import MAX_BROADCAST_IDS, documents, write_table

#: Fingerprints that a block of the merged filter holds on average.
BLOCK_FINGERPRINTS = 16_384
DIGESTS = "doc_id long, fingerprint long, text_sha256 string"


def normalised(text: str | None) -> bytes:
    """bytes.lower() touches A-Z only."""
    return (text or "").encode().lower()


def _sha(body: bytes) -> tuple[int, str]:
    h = hashlib.sha256(body)
    return int.from_bytes(h.digest()[:8], "big", signed=True), h.hexdigest()


class CountingQuotientFilter:
    """Sorted remainders with counts, grouped in runs by quotient. Quotient bits + remainder bits = 64."""

    def __init__(self, q_bits: int, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.q_bits, self.quotients, self.remainders, self.counts = q_bits, quotients, remainders, counts

    @classmethod
    def build(cls, q_bits: int, fingerprints: np.ndarray) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls.of(q_bits, values, counts)

    @classmethod
    def of(cls, q_bits: int, values: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        r = np.uint64(64 - q_bits)
        quotients = values >> r if q_bits else np.zeros_like(values)
        return cls(q_bits, quotients, values & np.uint64((1 << int(r)) - 1), counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        return (self.quotients << np.uint64(64 - self.q_bits) if self.q_bits else self.quotients) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Lossless: counts of equal (quotient, remainder) add up."""
        both = np.concatenate([self.fingerprints(), other.fingerprints()])
        order = np.argsort(both, kind="stable")  # a merge of two sorted runs
        both, counts = both[order], np.concatenate([self.counts, other.counts])[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        return self.of(self.q_bits, both[first], np.add.reduceat(counts, first) if len(first) else counts)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(quotient, remainders and counts) of each run."""
        starts = np.flatnonzero(np.r_[True, self.quotients[1:] != self.quotients[:-1]]) if len(self.quotients) else []
        for a, b in zip(starts, [*starts[1:], len(self.quotients)], strict=True):
            yield int(self.quotients[a]), self.remainders[a:b].tobytes() + self.counts[a:b].tobytes()

    @classmethod
    def read(cls, q_bits: int, quotient: int, data: bytes) -> CountingQuotientFilter:
        half = len(data) // 2
        remainders = np.frombuffer(data[:half], np.uint64)
        return cls(q_bits, np.full(len(remainders), quotient, np.uint64), remainders, np.frombuffer(data[half:], np.int64))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_sha(normalised(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["doc_id", "fingerprint", "text_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digest, DIGESTS)


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints with a count above one, from the merged filters. rows: of the input, which sets the quotient bits."""
    q_bits = max(0, int(np.ceil(np.log2(max(1, rows / BLOCK_FINGERPRINTS)))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        runs = list(CountingQuotientFilter.build(q_bits, np.concatenate(parts)).blocks()) if parts else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in runs], pa.int64()), pa.array([x[1] for x in runs], pa.binary())], names=["block", "filter"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.read(q_bits, key[0].as_py(), x) for x in table.column("filter").to_pylist()]
        while len(filters) > 1:  # pairwise, as in a tournament
            filters = [filters[i].merge(filters[i + 1]) if i + 1 < len(filters) else filters[i] for i in range(0, len(filters), 2)]
        f = filters[0]
        more = f.counts > 1
        return pa.table({"fingerprint": pa.array(f.fingerprints()[more].view(np.int64), pa.int64()), "copies": pa.array(f.counts[more], pa.int64())})

    return fingerprints.mapInArrow(build, "block long, filter binary").groupBy("block").applyInArrow(merge, "fingerprint long, copies long")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies = [normalised(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_sha(x)[0] for x in bodies], pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "fingerprint", "body"])


def copy_groups(docs: DataFrame, digest: DataFrame) -> DataFrame:
    """Groups of two or more rows with equal bytes: text_sha256, keep_id, group_size. digest: the written digests of docs."""
    repeated = write_table(repeated_fingerprints(digest.select("fingerprint"), digest.count()), "op9-repeated")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if repeated.count() > MAX_BROADCAST_IDS:  # route by doc_id, which no hot fingerprint skews
        routed = digest.join(repeated, "fingerprint", "left_semi").select("doc_id").distinct()
        docs = docs.join(routed, docs.doc_id.eqNullSafe(routed.doc_id), "left_semi")
    bodies = docs.mapInArrow(_bodies, "doc_id long, fingerprint long, body binary")
    if repeated.count() <= MAX_BROADCAST_IDS:
        bodies = bodies.join(F.broadcast(repeated), "fingerprint", "left_semi")
    # Grouping compares the bytes; copies within a partition fold into one row before the shuffle.
    groups = bodies.groupBy("fingerprint", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.filter("group_size > 1").select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = write_table(digests(docs), "op9-digests")
    groups = write_table(copy_groups(docs, digest), "op9-groups")
    return digest.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def keep_rows(docs: DataFrame) -> DataFrame:
    """docs without the copies: all columns, one row of each group."""
    verdicts = write_table(exact_groups(docs), "op9-verdicts")
    id_type, sha = docs.schema["doc_id"].dataType, "__text_sha256"

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shas = pa.array([_sha(normalised(t))[1] for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, shas], names=[*b.schema.names, sha])

    tagged = docs.mapInArrow(tag, StructType([*docs.schema.fields, StructField(sha, StringType())]))
    keys = verdicts.select(F.col("doc_id").cast(id_type).alias("__id"), F.col("text_sha256").alias("__sha"), "kept")

    def joined(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS // 8 else ids, (rows.doc_id.eqNullSafe(ids["__id"])) & (rows[sha] == ids["__sha"]), how)

    out = joined(tagged, keys.filter("not kept").select("__id", "__sha").distinct(), "left_anti")
    # Rows that repeat both doc_id and text are all "kept"; where there are any, one of each is left.
    again = keys.filter("kept").groupBy("__id", "__sha").count().filter("count > 1").select("__id", "__sha")
    if again.limit(1).count():
        again = write_table(again, "op9-again")
        out = joined(out, again, "left_anti").unionByName(joined(out, again, "left_semi").dropDuplicates(["doc_id", sha]))
    return out.drop(sha)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP9_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
