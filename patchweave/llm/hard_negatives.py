"""Hard negatives by a vector-approximation file.

Vectors become integers (floor(256 * x)) and are packed into blocks of rows, the file: for each row an 8-bit cell per
dimension, and the exact integers behind them. Cell borders are quantiles of a bounded sample, fitted once; a block
closes its outermost cells by its own least and greatest values, so bounds hold for every row. For an anchor, a table of
a dimension's cells gives the least and the greatest product with the anchor's component; summed over the dimensions
they bound the score, and only rows whose bounds let them enter a window are scored exactly.

1. Positives: an anchor's first rows of its label. In a block, rows whose upper bound reaches the k-th best lower bound
   are scored; the k best of each block meet.
2. Negatives: each positive opens a window of scores, a share of its own score up to itself. In a block, rows of other
   labels whose bounds touch the window and whose upper bound reaches the k-th best lower bound among those that surely
   lie in it are scored; the k best of each block meet.

Anchors are a stated set that meets all rows in blocks: blocks of MAX_ANCHORS anchors are sent to every part of the
file, so a task holds one block of each, whatever the size, and nothing is broadcast or collected but the cell borders.

Scores are exact integers. Higher scores come first, ties by smaller id.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part, nor do rows
without id; of rows that repeat an id the one with the least label, then vector takes part; vectors of several lengths
are padded with zeros; an anchor's own id is neither its positive nor its negative; with no positives, or none in the
window (a negative positive score opens none), an anchor returns nothing; components beyond 2**22 either way are held
there, so that no sum exceeds a long at up to 2**11 dimensions; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchweave.llm.common import drop_table, write_table

SCALE, LIMIT = 256, 2**22
#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A window: from so many hundredths of the positive's score to as many.
LOW, HIGH = 80, 100
#: Rows and anchors that a block holds at most, cells of a dimension, and rows of the sample that sets their borders.
MAX_ROWS, MAX_ANCHORS, CELLS, SAMPLE = 4_096, 512, 16, 4_096
#: Bound of an anchor's table entries that are summed at once.
CHUNK = 1 << 20
BLOCK = "part int, dims int, ids array<long>, labels array<long>, cells binary, vectors binary"
POSITIVE = "anchor_id long, positive_id long, positive_score long"
NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def clean(vectors: DataFrame, id_column: str = "vec_id", label: Column | None = None, vector_column: str = "embedding") -> DataFrame:
    """id, label and integer vector of the rows that take part, a row per id."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = lambda x: F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    rows = rows.filter("id is not null and label is not null and v is not null").filter(finite)
    whole = rows.select("id", "label", F.transform("v", lambda x: F.floor(held(x)).cast("int")).alias("v"))
    return whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def _padded(lists: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def cell_borders(rows: DataFrame, dims: int) -> np.ndarray:
    """(dims, CELLS - 1) borders: quantiles of SAMPLE rows, those with the least hashes of their ids."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(sample):
        return np.zeros((dims, CELLS - 1), np.int64)
    v = _padded([list(x) for x in sample], dims)
    return np.quantile(v, np.arange(1, CELLS) / CELLS, axis=0, method="nearest").T.astype(np.int64)


def _packed(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, borders: np.ndarray, part: int) -> list:
    cells = np.stack([np.searchsorted(b, v[:, d], side="right") for d, b in enumerate(borders)], axis=1).astype(np.uint8) if len(borders) else np.zeros(v.shape, np.uint8)
    return [part, v.shape[1], ids.tolist(), labels.tolist(), cells.tobytes(), v.astype(np.int32).tobytes()]


def blocks(rows: DataFrame, dims: int, borders: np.ndarray, size: int, parts: int) -> DataFrame:
    """BLOCK rows of up to so many rows; part: the place of 0 to parts - 1 where a block is dealt to."""
    schema = pa.schema([("part", pa.int32()), ("dims", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("cells", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def pack() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids = t.column("id").to_numpy()
            one = _packed(ids, t.column("label").to_numpy(), _padded(t.column("v").to_pylist(), dims), borders, int(ids[0]) % parts)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(one, schema, strict=True)], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, size):
                piece = b.slice(at, size)
                if n + piece.num_rows > size:
                    yield pack()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield pack()

    return rows.mapInArrow(run, BLOCK)


class _Block:
    def __init__(self, row: dict, prefix: str = "") -> None:
        self.ids, self.labels = (np.array(row[f"{prefix}{x}"], np.int64) for x in ("ids", "labels"))
        n, dims = len(self.ids), row[f"{prefix}dims"]
        self.cells = np.frombuffer(row[f"{prefix}cells"], np.uint8).reshape(n, dims)
        self.vectors = np.frombuffer(row[f"{prefix}vectors"], np.int32).reshape(n, dims).astype(np.int64)

    def edges(self, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dims, CELLS): least and greatest integer of each cell in this block."""
        low = np.c_[self.vectors.min(axis=0), borders]
        high = np.c_[borders - 1, self.vectors.max(axis=0)]
        return low, np.maximum(low, high)


def _bounds(block: _Block, rows: np.ndarray, anchors: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, anchors): lower and upper bounds of scores, by looking up each dimension's table."""
    low, high = np.zeros((len(rows), len(anchors)), np.int64), np.zeros((len(rows), len(anchors)), np.int64)
    cells = block.cells[rows]
    for d in range(cells.shape[1]):
        one, two = edges[0][d][:, None] * anchors[None, :, d], edges[1][d][:, None] * anchors[None, :, d]
        low += np.minimum(one, two)[cells[:, d]]
        high += np.maximum(one, two)[cells[:, d]]
    return low, high


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest, or what every value reaches where there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else int(np.iinfo(np.int64).min)


def _best(block: _Block, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places in rows of the k first by score, then id."""
    return np.lexsort((block.ids[rows], -scores))[:k]


def _local_positives(borders: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pair in b.to_pylist():
                out, file, asked = [], _Block(pair), _Block(pair, "a_")
                edges = file.edges(borders)
                for label in np.unique(asked.labels):
                    rows, some = np.flatnonzero(file.labels == label), np.flatnonzero(asked.labels == label)
                    for part in np.array_split(some, -(-len(some) * max(1, len(rows)) // CHUNK)) if len(rows) else ():
                        low, high = _bounds(file, rows, asked.vectors[part], edges)
                        for c, a in enumerate(part):
                            other = file.ids[rows] != asked.ids[a]
                            may = rows[other & (high[:, c] >= _kth(low[other, c], k))]
                            scores = file.vectors[may] @ asked.vectors[a]
                            out += [(int(asked.ids[a]), int(file.ids[may[i]]), int(scores[i])) for i in _best(file, may, scores, k)]
                yield _batch(out, POSITIVE)

    return run


def _local_negatives(borders: np.ndarray, k: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pair in b.to_pylist():
                out, file, asked = [], _Block(pair), _Block(pair, "a_")
                edges, all_rows = file.edges(borders), np.arange(len(file.ids))
                windows = dict(zip(pair["a_ids_of"], pair["a_positives"], strict=True))
                some = np.array([i for i, x in enumerate(asked.ids.tolist()) if x in windows], np.int64)
                for part in np.array_split(some, max(1, -(-len(some) * len(all_rows) // CHUNK))):
                    if not len(part):
                        continue
                    low, high = _bounds(file, all_rows, asked.vectors[part], edges)
                    for c, a in enumerate(part):
                        other = file.labels != asked.labels[a]
                        known: dict[int, np.ndarray] = {}
                        for p in windows[int(asked.ids[a])]:
                            top, s = p["positive_score"], 100
                            sure = other & (s * low[:, c] >= share[0] * top) & (s * high[:, c] <= share[1] * top)
                            may = np.flatnonzero(other & (s * high[:, c] >= share[0] * top) & (s * low[:, c] <= share[1] * top) & (high[:, c] >= _kth(low[sure, c], k)))
                            scores = file.vectors[may] @ asked.vectors[a]
                            ok = (s * scores >= share[0] * top) & (s * scores <= share[1] * top)
                            may, scores = may[ok], scores[ok]
                            out += [(int(asked.ids[a]), p["positive_id"], top, int(file.ids[may[i]]), int(scores[i])) for i in _best(file, may, scores, k)]
                yield _batch(out, NEGATIVE)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)


def _first(rows: DataFrame, keys: list[str], score: str, id_column: str, k: int) -> DataFrame:
    """The k first rows of each key, with their rank; applied before the shuffle, too."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id_column)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (LOW, HIGH)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors against rows, both of clean()."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, anchors = write_table(rows, "op13-rows"), write_table(anchors, "op13-anchors")
    dims = rows.unionByName(anchors).agg(F.coalesce(F.max(F.size("v")), F.lit(0))).head()[0]
    borders = cell_borders(rows, dims)
    file = write_table(blocks(rows, dims, borders, MAX_ROWS, parts), "op13-file")
    asked = write_table(blocks(anchors, dims, borders, MAX_ANCHORS, parts), "op13-asked")
    drop_table(rows)
    drop_table(anchors)

    def met(blocks_of_anchors: DataFrame) -> DataFrame:
        """Every block of the file with every block of anchors."""
        sent = blocks_of_anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        sent = sent.select("part", *(F.col(c).alias(f"a_{c}") for c in sent.columns if c != "part"))
        return file.hint("merge").join(sent, "part")

    near = met(asked).mapInArrow(_local_positives(borders, positives), POSITIVE)
    near = write_table(_first(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "op13-positives")
    # Each block of anchors gets its anchors' positives; ids are unique, so the first one names the block.
    place = asked.select(F.col("ids")[0].alias("block"), F.explode("ids").alias("anchor_id"))
    own = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))
    windows = place.join(own.hint("merge"), "anchor_id").groupBy("block").agg(F.collect_list(F.struct("anchor_id", "p")).alias("w"))
    windows = windows.select("block", F.col("w.anchor_id").alias("ids_of"), F.col("w.p").alias("positives"))
    ready = asked.withColumn("block", F.col("ids")[0]).join(windows.hint("merge"), "block").drop("block")
    found = met(ready).mapInArrow(_local_negatives(borders, negatives, share), NEGATIVE)
    best = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    rows = clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)
    return hard_negatives(rows, rows.filter("id % 100 = 0"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.id AS anchor_id, o.id AS other_id, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM v a JOIN v o ON a.id <> o.id WHERE a.id % 100 = 0
),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT * FROM n WHERE rank <= 5
"""
