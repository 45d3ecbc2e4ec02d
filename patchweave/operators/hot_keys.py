"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are ever broadcast.
MAX_HOT = 100_000
#: Keys with fewer rows are never hot.
LEAST_HOT = 100


def join_counted(rows: DataFrame, per_key: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with per_key, which has a row per key and in n, which is dropped, the number of the key's rows.

    total: the sum of n or more. Keys with more than total / MAX_HOT rows are fewer than MAX_HOT, whatever the input, so
    they're broadcast and their rows stay where they are; of the keys that are shuffled none fills a task."""
    hot = F.col(n) > max(LEAST_HOT, total // MAX_HOT)
    hubs = per_key.filter(hot).drop(n)
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(hubs.select(*keys)), keys, "left_anti").join(per_key.filter(~hot).drop(n), keys)
    return rows.join(F.broadcast(hubs), keys).unionByName(rest)
