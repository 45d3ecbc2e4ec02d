"""Incremental batch: upserts by key, seeded rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources whose ratings go stale and are never carried over from a seed.
PERISHABLE = ("EPSS", "KEV")


def last_writes(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the highest sequence for each key, folded before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("x"))
    return best.select(*keys, "x.*").select(*rows.columns)


def merge_seed(seed: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows, and those of the seed that no fresh row replaces and that don't go stale."""
    kept = seed.filter(~F.col("source").isin(*PERISHABLE)) if "source" in seed.columns else seed
    return fresh.unionByName(kept.join(fresh, keys, "left_anti"))
