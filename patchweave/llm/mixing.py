"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Words are dealt in blocks: a text is cut into blocks of BLOCK_WORDS words (its last one is shorter). A source's target
is its weight's share of all words, at most MAX_EPOCHS times its size; the excess is shared again by weight. A target
means whole epochs over all the source's blocks and a part of one more: blocks in an order permuted anew for each
epoch, up to the target (the block at the boundary is cut). These block slots are the source's exact quota.

Output shards: a tree halves the shards; at each node the quotas of the left half are one draw of the multivariate
hypergeometric distribution, seeded by the node, so that any task can walk to its own shards and reruns agree. The
draws give each shard an interval of each source's permuted slots, so shards hold disjoint blocks; within a shard
blocks are shuffled by a hash. The report tells where each document's blocks went; mixed_rows() puts its rows out in
this order, shard after shard, and cuts a document where its blocks went to several shards.

A slot's rank is found without a window over a whole source or shard: blocks are counted in buckets of a hash, buckets
are summed up, and only the blocks of one bucket are ranked together.

Defined results: a null text has size 0 and is never taken; sources are ordered by code point with null last, and a
null source is a source; with no words at all every target is 0; a document is its doc_id, source and text: rows that
repeat all three are documents of their own, and rows that share less are told apart by a digest of the text; ties of
hash are broken by doc_id and digest; a null doc_id is dealt as any other; an empty table gives an empty result; further columns are ignored by the plan and kept by mixed_rows().
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from patchweave.llm.common import WORD, documents, write_table

BLOCK_WORDS = 1_024
MAX_EPOCHS = 3
SHARD_WORDS = 20_000_000
#: Output shards at least, whatever the size (with fewer slots, as many as there are), so that shards can be read apart
#: and each one is a draw.
LEAST_SHARDS = 64
BUCKET_BLOCKS = 4_096
#: Slots of a shard that mixed_rows() puts into one partition.
PART_SLOTS = 4_096
WEIGHTS = (1.0, 2.0, 3.0)
#: Sources whose totals are collected and whose quotas the tree splits one by one. Of more sources, targets are found by
#: aggregates, and the tree splits this many groups of them: the slots of a group are permuted together, so that an
#: interval of them is a draw from its sources, too.
MAX_SOURCES = 200_000
#: Up to here numpy draws from the hypergeometric distribution.
NUMPY_RANGE = 10**9


def targets(sizes: list[int], weights: list[float], most: float = MAX_EPOCHS) -> list[float]:
    """Shares of the sum of sizes by weight, none above most times its size; what is above is shared again."""
    out = [0.0] * len(sizes)
    # Capped first are those with the least size for their weight; the others share the rest.
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left = float(sum(sizes))
    later = list(itertools.accumulate((weights[i] for i in reversed(order)), initial=0.0))[::-1]  # weights from a place on
    for k, i in enumerate(order):
        weight = later[k]
        if most * sizes[i] < left * weights[i] / weight:
            out[i] = float(most * sizes[i])
            left -= out[i]
        else:
            for j in order[k:]:
                out[j] = left * weights[j] / weight
            break
    return out


def split_quotas(quotas: np.ndarray, shards: int, first: int, last: int, seed: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, starts, counts) for shards first..last-1: the intervals of each source's slots that they hold."""

    def walk(low: int, high: int, starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if high <= first or low >= last:
            return
        if high - low == 1:
            yield low, starts, counts
            return
        middle = (low + high) // 2
        total = int(counts.sum())
        # The left half takes its share of all slots; which sources they come from is the draw.
        n = total * (middle - low) // (high - low)
        left = _draw(np.random.default_rng([seed, low, high]), counts, n)
        yield from walk(low, middle, starts, left)
        yield from walk(middle, high, starts + left, counts - left)

    yield from walk(0, shards, np.zeros_like(quotas), quotas)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n slots drawn from good + bad are good, for any numbers of them: numpy's sampler in its range, and
    by inversion beyond it. There the probabilities around the mode follow from their ratios; what lies further than
    40 standard deviations out has no weight in a float."""
    if good + bad < NUMPY_RANGE:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))
    reach = int(40 * spread) + 50
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)  # from k to k + 1
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, last - first))


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw, source after source."""
    out, left, pool = np.zeros_like(counts), n, int(counts.sum())
    for i, c in enumerate(map(int, counts)):
        if left <= 0:
            break
        rest = pool - c
        x = (_hypergeometric(rng, c, rest, left) if rest else min(c, left)) if c else 0
        out[i] = min(max(x, left - rest, 0), c, left)
        left, pool = left - int(out[i]), rest
    return out


def _hash(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def _digest() -> Column:
    """Of the text's bytes; a null text is as an empty one, of which nothing is taken either."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _digest().alias("digest"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shard_words: int = SHARD_WORDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sized, slots): sized has doc_id, source, digest, size, source_size, target; slots has a row per block taken:
    doc_id, source, digest, size, epoch, block, from_word, words, shard, position (in the shard, from 0 and gapless)."""
    return _plan(docs, weights, shard_words, seed)[:2]


def _plan(docs: DataFrame, weights: tuple[float, ...], shard_words: int, seed: int) -> tuple[DataFrame, DataFrame, int, int]:
    """What plan() returns, the number of shards, and the most slots that one can have."""
    spark = docs.sparkSession
    sized = write_table(_sized(docs), "op2-sized")
    blocks_of = F.ceil(F.col("size") / BLOCK_WORDS).cast("long")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.sum(blocks_of).alias("blocks"))
    held = totals.limit(MAX_SOURCES + 1).collect()
    many = len(held) > MAX_SOURCES
    if many:
        sources, n_sources, goal_words = _sources_by_aggregates(write_table(totals, "op2-totals"), weights)
    else:
        held.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
        goal = targets([r.words for r in held], [weights[i % len(weights)] for i in range(len(held))]) if held else []
        sources, n_sources, goal_words = spark.createDataFrame([(i, r.source, r.words, r.blocks, t) for i, (r, t) in enumerate(zip(held, goal, strict=True))], "source_no long, source string, source_size long, blocks long, target double"), len(held), math.fsum(goal)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("epochs", whole).withColumn("rest", F.rint(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    side = _source_side(sources, many)
    known = sized.join(side, sized.source.eqNullSafe(side.source)).drop(side.source)

    # A row per block and epoch; the last epoch is partial.
    n_buckets = F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("blocks"), F.lit(1)) / BUCKET_BLOCKS)))).cast("long")
    dealt = (
        known.filter("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - F.when(F.col("rest") > 0, 0).otherwise(1))))
        .filter("epoch >= 0 and (epoch < epochs or rest > 0)")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks_of - 1)))
        .select("doc_id", "source_no", "digest", "size", "epoch", "block", F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("size") - F.col("block") * BLOCK_WORDS).alias("words"), _hash(F.lit(seed), "epoch", "doc_id", "block", "digest").alias("h"), n_buckets.alias("n_buckets"), "epochs", "rest", "blocks")
        .withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 8), "n_buckets"))
    )
    key = ["source_no", "epoch", "bucket"]
    counted = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("source_no", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    rank = Window.partitionBy(*key).orderBy("h", "doc_id", "block", "digest")
    ranked = (
        dealt.join(base, key)
        .withColumn("slot", F.col("epoch") * F.col("blocks") + F.col("n_before") + F.row_number().over(rank) - 1)
        .withColumn("w_upto", F.col("w_before") + F.sum("words").over(rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("words", F.when(F.col("epoch") < F.col("epochs"), F.col("words")).otherwise(F.least("words", F.col("rest") - (F.col("w_upto") - F.col("words")))))
        .filter("words > 0")
    )
    taken = write_table(ranked.select("doc_id", "source_no", "digest", "size", "epoch", "block", (F.col("block") * BLOCK_WORDS).alias("from_word"), "words", "slot"), "op2-taken")
    # The tree splits strata: a source each, or groups of sources.
    width = -(-n_sources // MAX_SOURCES) if many else 1
    taken = taken.withColumn("stratum", F.floor(F.col("source_no") / width).cast("int"))
    if many:
        taken = write_table(_permuted_together(taken, seed), "op2-strata")
    quotas = {r.stratum: r.n for r in taken.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_SOURCES
    total = sum(quotas.values())
    shards = max(1, min(total, max(LEAST_SHARDS, round(int(goal_words) / shard_words))))
    slots = _to_shards(taken, side, np.array([quotas.get(i, 0) for i in range(-(-n_sources // width))], np.int64), shards, seed)
    return _with_targets(sized, side), slots, shards, total // shards + 1


def _source_side(sources: DataFrame, many: bool) -> DataFrame:
    """sources as a side of a join: broadcast where they are at most MAX_SOURCES rows, else shuffled (AQE splits a hot
    source's rows)."""
    return sources.hint("merge") if many else F.broadcast(sources)


def _sources_by_aggregates(totals: DataFrame, weights: tuple[float, ...], most: float = MAX_EPOCHS) -> tuple[DataFrame, int, float]:
    """(sources, how many, words of all targets) for any number of sources: numbers in their order from a range sort and
    the counts of its partitions, targets as the lesser of most times the size and the weight's share of a level. The
    level rises with each pass until no further source is capped."""
    spark = totals.sparkSession
    ordered = totals.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source").withColumn("__m", F.monotonically_increasing_id())
    ordered = write_table(ordered.select("*", F.shiftright("__m", 33).alias("__part"), F.col("__m").bitwiseAND((1 << 33) - 1).alias("__row")), "op2-ordered")
    counts = sorted((r["__part"], r["count"]) for r in ordered.groupBy("__part").count().collect())  # a row per partition
    before = dict(zip((p for p, _ in counts), itertools.accumulate((n for _, n in counts), initial=0), strict=False))
    offsets = F.broadcast(spark.createDataFrame(list(before.items()), "__part long, __before long"))
    numbered = ordered.join(offsets, "__part").withColumn("source_no", F.col("__before") + F.col("__row"))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int"))
    rows = write_table(numbered.select("source_no", "source", F.col("words").alias("source_size"), "blocks", weight.alias("weight")), "op2-numbered")
    total, level, capped = float(rows.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        over = most * F.col("source_size") < level * F.col("weight")
        r = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most * F.col("source_size")).otherwise(0.0)).alias("spent"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count(F.lit(1)).alias("all")).first()
        if r.n == capped or not r.weight:
            break
        capped, level = r.n, (total - r.spent) / r.weight
    goal = F.least(most * F.col("source_size"), level * F.col("weight")).cast("double")
    return rows.select("source_no", "source", "source_size", "blocks", goal.alias("target")), sum(n for _, n in counts), total


def _permuted_together(taken: DataFrame, seed: int) -> DataFrame:
    """taken with slots numbered anew within each stratum, in the order of a hash over all its sources' slots."""
    sizes = taken.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    buckets = F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / BUCKET_BLOCKS)))).cast("long")
    rows = taken.join(F.broadcast(sizes), "stratum").withColumn("h", _hash(F.lit(seed), "source_no", "slot")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 8), buckets))  # at most MAX_SOURCES strata
    counted = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("stratum", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("n_before"))
    rank = Window.partitionBy("stratum", "bucket").orderBy("h", "source_no", "slot")
    return rows.join(base, ["stratum", "bucket"]).withColumn("slot", F.col("n_before") + F.row_number().over(rank) - 1).select(taken.columns)


def _with_targets(sized: DataFrame, side: DataFrame) -> DataFrame:
    s = side.select(F.col("source").alias("__source"), "source_size", "target")
    return sized.join(s, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _to_shards(taken: DataFrame, sources: DataFrame, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """Gives each slot its shard, by the tree's intervals, and its place there."""
    spark, per_shard = taken.sparkSession, max(1, int(quotas.sum()) // shards)
    step = min(per_shard, BUCKET_BLOCKS)
    shared = spark.sparkContext.broadcast(quotas)  # at most MAX_SOURCES numbers

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            if not ids:
                continue
            for shard, starts, counts in split_quotas(shared.value, shards, min(ids), max(ids) + 1, seed):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), shard, np.int64)), pa.array(starts[at]), pa.array(starts[at] + counts[at])], names=["stratum", "shard", "low", "high"])

    held = spark.range(0, shards, 1, max(1, min(shards // 64, 10_000))).mapInArrow(intervals, "stratum int, shard long, low long, high long")
    # Which interval a slot lies in: intervals are cut at multiples of step, and within such a stretch the last interval
    # that starts at or before the slot is carried on.
    stretch = lambda c: F.floor(F.col(c) / step).cast("long")
    marks = held.withColumn("stretch", F.explode(F.sequence(stretch("low"), F.floor((F.col("high") - 1) / step).cast("long")))).select(
        "stratum", "stretch", F.greatest("low", F.col("stretch") * step).alias("slot"), F.lit(0).alias("is_slot"), F.col("shard").alias("mark")
    )
    slots = taken.withColumn("stretch", stretch("slot")).withColumn("is_slot", F.lit(1)).withColumn("mark", F.lit(None).cast("long"))
    carried = Window.partitionBy("stratum", "stretch").orderBy("slot", "is_slot")
    placed = slots.unionByName(marks, allowMissingColumns=True).withColumn("shard", F.last("mark", True).over(carried)).filter("is_slot = 1").drop("is_slot", "mark", "stretch")
    # The place: buckets are stretches of the hash by which a shard is sorted.
    bits = max(1, math.ceil(math.log2(per_shard / BUCKET_BLOCKS)))
    placed = write_table(placed.withColumn("h", _hash(F.lit(seed), "shard", "stratum", "slot")).withColumn("bucket", F.shiftright("h", 64 - bits)), "op2-placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    rank = Window.partitionBy("shard", "bucket").orderBy("h", "stratum", "slot")
    placed = placed.join(base, ["shard", "bucket"]).withColumn("position", F.col("n_before") + F.row_number().over(rank) - 1)
    names = sources.select("source_no", "source")
    return placed.join(names, "source_no").select("doc_id", "source", "digest", "size", "epoch", "block", "from_word", "words", "shard", "position")


def report(docs: DataFrame, shard_words: int = SHARD_WORDS, seed: int = 1) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, first_shard (null where nothing is taken), n_shards
    and positions_hash, a digest of where in the shards its blocks are."""
    sized, slots = plan(docs, shard_words=shard_words, seed=seed)
    place = F.bit_xor(F.xxhash64("shard", "position", "epoch", "block")).alias("positions_hash")  # no two slots share shard and position
    taken = slots.groupBy("doc_id", "source", "digest").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"), F.count_distinct("shard").alias("n_shards"), place)
    # Rows that repeat doc_id, source and text share what their blocks got, and their places.
    rows = sized.groupBy("doc_id", "source", "digest", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(taken.withColumnsRenamed({"doc_id": "__d", "source": "__s", "digest": "__t"}), F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("digest") == F.col("__t")), "left")
    each = joined.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    total = F.coalesce("taken", F.lit(0))
    share = (F.floor(total / F.col("n")) + F.when(F.col("i") <= total % F.col("n"), 1).otherwise(0)).cast("long")
    return each.select("doc_id", "size", "source_size", "target", share.alias("taken"), "first_shard", F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"), "positions_hash")


_WORD = re.compile(WORD)


def _piece(text: str, first: int, n: int) -> str:
    """Words first..first+n-1 of a text with what stands between them."""
    start = end = None
    for i, m in enumerate(_WORD.finditer(text)):
        if i == first:
            start = m.start()
        if i == first + n - 1:
            end = m.end()
            break
    return text[start:end] if start is not None else ""


def _layers(parts: list[dict]) -> list[list[dict]]:
    """The parts of one epoch in one shard; a block that repeated rows brought in twice goes to a layer of its own."""
    out: list[list[dict]] = []
    at, nth = None, 0
    for x in parts:
        at, nth = x["from_word"], nth + 1 if x["from_word"] == at else 0
        if nth == len(out):
            out.append([])
        out[nth].append(x)
    return out


def mixed_rows(docs: DataFrame, shard_words: int = SHARD_WORDS, seed: int = 1) -> DataFrame:
    """The mix as rows with the columns of docs: a document once for each epoch and shard that takes words of it, its
    text cut to the words taken (runs of blocks stay together) and n_chars to match. Rows come shard after shard, in
    the order of their first blocks' positions; a partition holds a stretch of one shard."""
    sized, slots, shards, most = _plan(docs, WEIGHTS, shard_words, seed)
    runs = slots.groupBy("doc_id", "source", "digest", "size", "epoch", "shard").agg(F.array_sort(F.collect_list(F.struct("from_word", "position", "words"))).alias("parts"))
    # parts: at most the blocks of one document.
    whole = runs.groupBy("doc_id", "source", "digest", "size").agg(F.collect_list(F.struct("shard", "parts")).alias("runs"))
    key = ["__doc", "__source", "__digest"]
    right = whole.select(*(F.col(c).alias(k) for c, k in zip(("doc_id", "source", "digest"), key, strict=True)), F.col("size").alias("__n"), F.col("runs").alias("__runs"))
    left = docs.withColumn("__text", _digest())
    joined = left.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col(key[0])) & F.col("source").cast("string").eqNullSafe(F.col(key[1])) & (F.col("__text") == F.col(key[2])))
    if sized.groupBy("doc_id", "source", "digest").count().filter("count > 1").limit(1).count():
        joined = joined.dropDuplicates(key)  # rows that repeat: their slots are told apart below
    names = docs.columns
    n_chars = next((i for i, c in enumerate(names) if c == "n_chars"), None)
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, texts, shard, position = [], [], [], []
            for i, (text, size, runs) in enumerate(zip(b.column(text_at).to_pylist(), b.column("__n").to_pylist(), b.column("__runs").to_pylist(), strict=True)):
                for held, parts in ((r["shard"], layer) for r in runs for layer in _layers(r["parts"])):
                    if sum(x["words"] for x in parts) >= size:
                        texts.append(text)
                    else:
                        joined_parts: list[list[int]] = []
                        for x in parts:
                            if joined_parts and sum(joined_parts[-1]) == x["from_word"]:
                                joined_parts[-1][1] += x["words"]
                            else:
                                joined_parts.append([x["from_word"], x["words"]])
                        texts.append("\n".join(_piece(text, *p) for p in joined_parts))
                    take.append(i)
                    shard.append(held)
                    position.append(min(x["position"] for x in parts))
            rows = b.select(names).take(pa.array(take, pa.int64()))
            columns = list(rows.columns)
            columns[text_at] = pa.array(texts, pa.string())
            if n_chars is not None:
                columns[n_chars] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[n_chars].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard, pa.int64()), pa.array(position, pa.int64())], names=[*names, "__shard", "__position"])

    placed = StructType([*docs.schema.fields, StructField("__shard", LongType()), StructField("__position", LongType())])
    rows = joined.select(*names, "__n", "__runs").mapInArrow(run, placed)
    stretches = -(-most // PART_SLOTS)
    part = F.col("__shard") * stretches + F.floor(F.col("__position") / PART_SLOTS)
    return rows.repartitionById(shards * stretches, part.cast("int")).sortWithinPartitions("__shard", "__position").select(names)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
