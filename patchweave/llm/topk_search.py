"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's 64 bits are the signs of its vector's components. Codes are cut into m segments, about log2 of the number of
codes long, and each segment is indexed. Round r probes every segment with all values at r bits from the query's; a
code is taken in the round and at the segment where it is met first, so none comes twice. After round r every code
within m * (r + 1) - 1 bits has been met (pigeonhole), so a query is done once k verified neighbours lie within that
distance. The rest go on to round r + 1.

The index is written once. Values that many codes share are split into pieces, which a probe visits all; joins state
their shuffle, and each round's finished queries are appended to one table, so nothing grows on the driver.

Equal codes are one entry with a count, and equal queries are searched once; of a code's vectors only the k + 1 with
the smallest ids can be among the k nearest, so many equal vectors cost nothing.

Neighbours are ordered by distance, then vec_id; a query is not its own neighbour.

Defined results: vectors that are null, and rows without vec_id, are neither queries nor neighbours; missing or null
components count as 0 (an unset bit), components beyond the 64th are folded onto the bit of their position modulo 64;
rows that repeat a vec_id are one vector (the code of its least value); with fewer than k other vectors all are
returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchweave.llm.common import MAX_BROADCAST_IDS, drop_table, new_path, write_table

BITS = 64
#: Probes that a batch holds at most.
BATCH = 200_000
#: Codes that share a segment's value and stay in one group of the join; hotter values are split by a hash.
BUCKET_CODES = 1_024


def code(column: str) -> Column:
    """The 64 signs of a vector's components as a long."""
    bit = f"aggregate(sequence(i, greatest(i, size({column}) - 1), {BITS}), 0D, (s, j) -> s + coalesce(cast(get({column}, j) as double), 0D)) > 0"
    return F.expr(f"case when {column} is not null then aggregate(sequence(0, {BITS - 1}), 0L, (a, i) -> a | shiftleft(case when {bit} then 1L else 0L end, i)) end")


def segments(n_codes: int) -> list[tuple[int, int]]:
    """(first bit, length) of each segment."""
    m = min(BITS, max(1, math.ceil(BITS / max(4.0, math.log2(max(2, n_codes))))))
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _value(column: str, first: int, length: int) -> Column:
    mask = (1 << length) - 1
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))


def _probes(parts: list[tuple[int, int]], radius: int):
    """Rows of queries (q, bound) -> (segment, value, q, bound) at exactly radius bits."""
    schema = pa.schema([("segment", pa.int32()), ("value", pa.int64()), ("q", pa.int64()), ("bound", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, bound = b.column("q").to_numpy(), b.column("bound").to_numpy()
            for s, (first, length) in enumerate(parts):
                if radius > length:
                    continue
                values = (q.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << length) - 1)
                flips = (sum(1 << i for i in c) for c in itertools.combinations(range(length), radius))
                while chunk := list(itertools.islice(flips, max(1, BATCH // max(1, len(q))))):
                    masks = np.array(chunk, np.uint64)
                    found = (values[:, None] ^ masks[None, :]).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), s, np.int32)), pa.array(found.view(np.int64)), pa.array(np.repeat(q, len(masks))), pa.array(np.repeat(bound, len(masks)))], schema=schema)

    return run


def _indexed(codes: DataFrame, parts: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(index, hot): a row per code and segment, and the values that are split: segment, value, pieces (at most one row
    for BUCKET_CODES rows of the index)."""
    of_segment = F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), _value("code", *p).alias("value")) for s, p in enumerate(parts))))
    rows = codes.select(of_segment.alias("x"), "code", "first_id", "n").select("x.segment", "x.value", "code", "first_id", "n")
    sizes = rows.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > BUCKET_CODES)
    hot = write_table(sizes.select("segment", "value", F.ceil(F.col("held") / BUCKET_CODES).cast("int").alias("pieces")), "op8-hot")
    piece = F.coalesce(F.pmod(F.xxhash64("code"), F.col("pieces")), F.lit(0)).cast("int")
    return write_table(_with_pieces(rows, hot).withColumn("piece", piece).drop("pieces"), "op8-index"), hot


def _with_pieces(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with pieces, null for values that aren't split; hot is broadcast only where it is counted to be small."""
    side = F.broadcast(hot) if hot.count() <= MAX_BROADCAST_IDS else hot.hint("shuffle_hash")
    return rows.join(side, ["segment", "value"], "left")


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query code q the k first codes by (distance, first_id) of a written table codes (code, first_id, n):
    q, code, distance, first_id, n."""
    spark, n_codes = codes.sparkSession, codes.count()
    parts = segments(n_codes)
    index, hot = _indexed(codes, parts)
    # A stated number keeps the tasks of a join whose probes are few bytes and many comparisons.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = lambda p: F.bit_count(_value("q", *p).bitwiseXOR(_value("code", *p)))
    # A query's own row (without a code) leads its candidates, so that a query that met none is kept, too.
    order = Window.partitionBy("q").orderBy(F.col("code").isNotNull(), "distance", "first_id")
    whole = Window.partitionBy("q")
    where, last = new_path(spark, "op8-rounds"), max(length for _, length in parts)
    schema = "q long, code long, distance int, first_id long, n long, done boolean, bound int"
    own = lambda df: df.select("q", *(F.lit(None).cast(t).alias(c) for c, t in (("code", "long"), ("distance", "int"), ("first_id", "long"), ("n", "long"))))
    active, found = queries.select("q", F.lit(BITS).alias("bound")), None
    for radius in range(last + 1):
        # Met here first: nearer segments don't exist, and equally near ones come later.
        first = F.lit(True)
        for i, p in enumerate(parts):
            first = first & F.when(F.col("segment") > i, near(p) > radius).otherwise(near(p) >= radius)
        probes = _with_pieces(active.mapInArrow(_probes(parts, radius), "segment int, value long, q long, bound int"), hot)
        probes = probes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
        key = ["segment", "value", "piece"]
        met = probes.repartition(tasks, *key).hint("merge").join(index, key)
        hits = met.withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")).filter(F.col("distance") <= F.col("bound")).filter(first).select("q", "code", "distance", "first_id", "n")
        pool = hits.unionByName(own(active))
        pool = pool if found is None else pool.unionByName(found)
        best = pool.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1)
        covered = min(BITS, len(parts) * (radius + 1) - 1)
        sure = F.coalesce(F.sum(F.when(F.col("distance") <= covered, F.col("n"))).over(whole), F.lit(0))
        bound = F.when(F.count("code").over(whole) >= k, F.max("distance").over(whole)).otherwise(BITS).cast("int")
        at = f"{where}/round={radius}"
        best.select("q", "code", "distance", "first_id", "n", (F.lit(radius == last) | (sure >= k) | (F.count("code").over(whole) >= n_codes)).alias("done"), bound.alias("bound")).write.parquet(at)
        left = spark.read.schema(schema).parquet(at).filter("not done")
        active, found = left.filter("code is null").select("q", "bound"), left.filter("code is not null").select("q", "code", "distance", "first_id", "n")
        if not active.limit(1).count():
            break
    for old in (index, hot):
        drop_table(old)
    return spark.read.schema(schema).parquet(where).filter("done and code is not null").select("q", "code", "distance", "first_id", "n")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, neighbor_id and distance of the k nearest vectors for each row of queries."""
    coded = lambda df: df.select(F.col(id_column).cast("long").alias("id"), code(vector_column).alias("code")).filter("id is not null and code is not null")
    once = lambda df: coded(df).groupBy("id").agg(F.min("code").alias("code"))
    rows, asked = write_table(once(vectors), "op8-rows"), write_table(once(queries), "op8-queries")
    codes = write_table(rows.groupBy("code").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "op8-codes")
    near = nearest_codes(codes, asked.select(F.col("code").alias("q")).distinct(), k + 1)
    # The k + 1 smallest ids of a code; the limit is applied before the shuffle, too.
    few = rows.withColumn("i", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("i") <= k + 1).drop("i")
    hits = near.select("q", "code", "distance").hint("merge").join(few, "code")
    best = hits.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).filter(F.col("i") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("hits"))  # k + 1 entries
    answered = asked.join(lists.hint("merge"), asked.code == lists.q)
    kept = F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(kept).alias("i", "h")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("h.id").alias("neighbor_id"), F.col("h.distance").alias("distance"))


def op8_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP8_SQL = """
WITH c AS (SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS b FROM embeddings),
d AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, CAST(bit_count(xor(q.b, n.b)) AS INT) AS distance FROM c q JOIN c n ON q.vec_id <> n.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INT) AS rank, neighbor_id, distance
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 10
"""
