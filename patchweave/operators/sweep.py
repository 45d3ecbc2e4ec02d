"""Joins of points with the intervals that hold them, at a cost near the size of the result.

An equi-join on a name with a test of bounds compares every version of a package with every range of its advisories: a
name with 10^5 versions and 10^4 ranges costs 10^9 comparisons in one task. Here the points of all names are cut into
key ranges of about equal size (borders are quantiles of a sample by a hash of the row, as versions repeat), a point goes to its range and an interval
to those that it overlaps, and each range is swept once: its points lie sorted, an interval is two binary searches, and
what lies between is the result. An interval is repeated only for ranges all of whose points it holds, and two more.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from patchweave.tables import write_table

#: Points of a range, about; ranges that a small input still has for each shuffle partition; sampled points of a range.
RANGE_POINTS, LEAST_POINTS, SAMPLES = 200_000, 2_000, 8
#: Rows of the result in a batch.
BATCH = 100_000


def borders(points: DataFrame, by: str, key: str) -> list[tuple[str, str]]:
    """(name, key) where ranges start, the first one left out; points: a written table."""
    spark, n = points.sparkSession, points.count()
    ranges = max(-(-n // RANGE_POINTS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_POINTS))
    if ranges < 2:
        return []
    step = max(1, n // (SAMPLES * ranges))
    sample = sorted((r[0], r[1]) for r in points.filter(F.pmod(F.xxhash64(*points.columns), F.lit(step)) == 0).select(by, key).collect())  # about SAMPLES a range
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def _ends(keys: list[tuple], name: str, low: str | None, high: str | None, closed: bool) -> tuple[int, int]:
    """Places in sorted (name, key) pairs of what an interval holds; None: no end."""
    a = bisect_left(keys, (name,) if low is None else (name, low))
    if high is None:
        return a, bisect_left(keys, (name + "\0",))  # the least name above this one
    return a, (bisect_right if closed else bisect_left)(keys, (name, high))


def _swept(names_out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, keys, parts = None, [], [], []
        sorted_keys: list[tuple] | None = None
        held: pa.StructArray | None = None
        for b in batches:
            range_no, is_interval = b.column("range_no").to_numpy(), b.column("is_interval").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (range_no[1:] != range_no[:-1]) | (is_interval[1:] != is_interval[:-1])])
            for start, end in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                piece = b.slice(int(start), int(end - start))
                if range_no[start] != at:
                    at, names, keys, parts, sorted_keys, held = range_no[start], [], [], [], None, None
                if not is_interval[start]:
                    names += piece.column("name").to_pylist()
                    keys += piece.column("low").to_pylist()
                    parts.append(piece.column("point"))
                    continue
                if sorted_keys is None:
                    sorted_keys = list(zip(names, keys, strict=True))
                    held = pa.concat_arrays(parts) if parts else None
                if held is None:
                    continue
                ends = [_ends(sorted_keys, *x) for x in zip(*(piece.column(c).to_pylist() for c in ("name", "low", "high", "closed")), strict=True)]
                yield from _pairs(held, piece.column("interval"), np.array(ends, np.int64).reshape(-1, 2), names_out)

    return run


def _pairs(points: pa.StructArray, intervals: pa.StructArray, ends: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the result for intervals that hold points[ends[i, 0] : ends[i, 1]]."""
    sizes = np.maximum(ends[:, 1] - ends[:, 0], 0)
    upto = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BATCH, side="right")))
        n = sizes[first:last]
        if n.sum():
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = points.take(pa.array(np.repeat(ends[first:last, 0], n) + within))
            i = intervals.take(pa.array(np.repeat(np.arange(first, last), n)))
            yield pa.RecordBatch.from_arrays([*p.flatten(), *i.flatten()], names=names)
        first = last


def interval_join(points: DataFrame, intervals: DataFrame, by: str, key: str = "key", low: str = "low", high: str = "high", closed: str = "closed", written: bool = False) -> DataFrame:
    """points with the intervals of the same name that hold their key: low <= key < high, or key <= high where closed;
    a null low or high is no end. Rows with a null name or key are in no interval. All columns of points, and those of
    intervals but by, low, high and closed. written: points read a table, so that they needn't be written once more for
    their keys to be worked out only once."""
    points = points.filter(F.col(by).isNotNull() & F.col(key).isNotNull())
    points = points if written else write_table(points, "sweep-points")
    rest = [c for c in intervals.columns if c not in (by, low, high, closed)]
    rows = _dealt(points, points.columns, intervals, rest, by, key, low, high, closed)
    schema = StructType([*points.schema.fields, *(intervals.schema[c] for c in rest)] if rest else [*points.schema.fields, StructField("__none", IntegerType())])
    result = rows.mapInArrow(_swept(schema.names), schema)
    return result if rest else result.drop("__none")


def _dealt(points: DataFrame, kept: list[str], intervals: DataFrame, rest: list[str], by: str, key: str, low: str, high: str, closed: str, order: Sequence[str] = ()) -> DataFrame:
    """Points and intervals, each in the key ranges where it belongs and sorted there: points by name and key, then
    intervals by name and order."""
    cuts = borders(points, by, key)

    @F.pandas_udf(IntegerType())
    def place(name: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(name, k, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def places(name: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        starts = [bisect_right(cuts, (n, "" if x is None else x)) for n, x in zip(name, lo, strict=True)]
        return pd.Series([[a, bisect_right(cuts, (n + "\0",) if y is None else (n, y))] for a, n, y in zip(starts, name, hi, strict=True)])

    within = intervals.filter(F.col(by).isNotNull() & (F.col(low).isNull() | F.col(high).isNull() | (F.col(low) <= F.col(high))))
    text = lambda c, n: F.col(c).cast("string").alias(n)
    left = points.select(place(by, key).alias("range_no"), F.lit(False).alias("is_interval"), text(by, "name"), text(key, "low"), F.lit(None).cast("string").alias("high"), F.lit(False).alias("closed"), F.struct(*kept).alias("point"))
    right = within.withColumn("__p", places(by, low, high)).select(
        F.explode(F.sequence(F.col("__p")[0], F.col("__p")[1])).alias("range_no"), F.lit(True).alias("is_interval"), text(by, "name"), text(low, "low"), text(high, "high"), F.coalesce(closed, F.lit(False)).alias("closed"), F.struct(*(rest or [F.lit(0).alias("__none")])).alias("interval")
    )
    rows = left.unionByName(right, allowMissingColumns=True).repartitionById(len(cuts) + 1, "range_no")
    return rows.sortWithinPartitions("range_no", "is_interval", "name", *(F.col(f"interval.{c}") for c in order), "low")


#: Points of a row of first_intervals() at most.
RUN = 1_000


def decided(spans: list[tuple[int, int, int, bool, int]]) -> list[tuple[int, int, int, int]]:
    """spans (start, end, entry, error, number) of one group, sorted by entry and by place within it, as runs of points
    (start, end, hit, skip) for which the same spans decide; -1: none."""
    if len(spans) == 1:
        a, b, _, error, i = spans[0]
        return [(a, b, -1, i) if error else (a, b, i, -1)]
    turns: dict[int, tuple[list[int], list[int]]] = {}
    for n, (a, b, *_) in enumerate(spans):
        turns.setdefault(a, ([], []))[0].append(n)
        turns.setdefault(b, ([], []))[1].append(n)
    out, here, at = [], [], None
    for place in sorted(turns):
        if here:
            hit, skip, entry = -1, -1, ()
            for n in here:
                _, _, e, error, i = spans[n]
                if e == entry:
                    continue  # the first one of an entry decides it
                entry = e
                if not error:
                    hit = i
                    break
                skip = i if skip < 0 else skip
            out.append((at, place, hit, skip))
        begun, over = turns[place]
        for n in over:
            del here[bisect_left(here, n)]
        for n in begun:
            insort(here, n)
        at = place
    return out


def _first(names_out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, keys, parts = None, [], [], []
        sorted_keys: list[tuple] | None = None
        held: pa.StructArray | None = None
        open_at, open_spans, carry = None, [], None  # the last group, which may go on in the next piece
        for b in batches:
            range_no, is_interval = b.column("range_no").to_numpy(), b.column("is_interval").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (range_no[1:] != range_no[:-1]) | (is_interval[1:] != is_interval[:-1])])
            for start, end in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                piece = b.slice(int(start), int(end - start))
                if range_no[start] != at:
                    if open_spans:
                        yield from _runs(held, carry, decided(open_spans), names_out)
                    at, names, keys, parts, sorted_keys, held, open_at, open_spans, carry = range_no[start], [], [], [], None, None, None, [], None
                if not is_interval[start]:
                    names += piece.column("name").to_pylist()
                    keys += piece.column("low").to_pylist()
                    parts.append(piece.column("point"))
                    continue
                if sorted_keys is None:
                    sorted_keys = list(zip(names, keys, strict=True))
                    held = pa.concat_arrays(parts) if parts else None
                if held is None:
                    continue
                intervals, shift = piece.column("interval"), 0
                if open_spans:
                    intervals, shift = pa.concat_arrays([carry, intervals]), len(carry)
                whole: list[tuple[int, int, int, int]] = []
                columns = [*(piece.column(c).to_pylist() for c in ("name", "low", "high", "closed")), *(pa.compute.struct_field(piece.column("interval"), c).to_pylist() for c in ("group", "entry", "error"))]
                for i, (name, low, high, closed, group, entry, error) in enumerate(zip(*columns, strict=True), shift):
                    a, z = _ends(sorted_keys, name, low, high, closed)
                    if a >= z:
                        continue
                    if (name, group) != open_at:
                        if open_spans:
                            whole += decided(open_spans)
                        open_at, open_spans = (name, group), []
                    open_spans.append((a, z, entry, error, i))
                if whole:
                    yield from _runs(held, intervals, whole, names_out)
                # Of the intervals only those of the open group stay, under new numbers.
                numbers = [s[4] for s in open_spans]
                carry = intervals.take(pa.array(numbers, pa.int64()))
                open_spans = [(*s[:4], n) for n, s in enumerate(open_spans)]
        if open_spans:
            yield from _runs(held, carry, decided(open_spans), names_out)

    return run


def _runs(points: pa.StructArray, intervals: pa.StructArray, runs: list[tuple[int, int, int, int]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows for runs of points, each with its hit and its skip; long runs are cut."""
    a, b, hit, skip = np.array(runs, np.int64).reshape(-1, 4).T
    pieces = -(-(b - a) // RUN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, hit, skip = np.repeat(a, pieces) + nth * RUN, np.repeat(hit, pieces), np.repeat(skip, pieces)
    sizes = np.minimum(np.repeat(b, pieces) - starts, RUN)
    upto = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BATCH, side="right")))
        n = sizes[first:last]
        ends = np.cumsum(n)
        held = points.take(pa.array(np.arange(ends[-1]) + np.repeat(starts[first:last] - (ends - n), n)))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), held)
        found = (intervals.take(pa.array(x[first:last], mask=x[first:last] < 0)) for x in (hit, skip))
        yield pa.RecordBatch.from_arrays([lists, *found], names=names)
        first = last


def first_intervals(points: DataFrame, intervals: DataFrame, by: str, kept: list[str], key: str = "key", low: str = "low", high: str = "high", closed: str = "closed") -> DataFrame:
    """For each point and group of intervals of the same name what comes first: points (an array of the columns kept, of
    points alike), hit and skip (structs of an interval's columns; one of them may be null).

    Intervals have group, entry, place and error, their order within a group. The first interval of an entry that holds
    a point decides the entry for it: hit is the first that decides and is no error, skip the first error before it.
    All that decides lies in one key range, so nothing is shuffled after the sweep, and points that lie side by side and
    share their intervals are one row. points: a written table."""
    points = points.filter(F.col(by).isNotNull() & F.col(key).isNotNull())
    rest = [c for c in intervals.columns if c not in (by, low, high, closed)]
    rows = _dealt(points, kept, intervals, rest, by, key, low, high, closed, ("group", "entry", "place"))
    interval = StructType([intervals.schema[c] for c in rest])
    schema = StructType([StructField("points", ArrayType(StructType([points.schema[c] for c in kept]))), StructField("hit", interval), StructField("skip", interval)])
    return rows.mapInArrow(_first(schema.names), schema)
