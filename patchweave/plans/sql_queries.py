"""Queries that are SQL text alone, over the library's SQL functions, each with its twin."""

from __future__ import annotations

from patchweave.functions import registry
from patchweave.plans import derive as D
from patchweave.plans.registry import query

_SQL = """
WITH i AS (SELECT DISTINCT l_partkey % 2000 AS n, concat(cast(l_linenumber AS int), '.', cast(l_quantity AS int), '.', l_suppkey % 10) AS version FROM lineitem),
k AS (SELECT v.version, version_key('npm', v.version) AS key FROM (SELECT DISTINCT version FROM i) v),
p AS (SELECT concat('GHSA-', p_partkey) AS advisory_id, p_partkey % 2000 AS n, concat(p_size % 4, '.', p_size % 7, '.0') AS low, concat(p_size % 4 + 1, '.', p_size, '.', p_partkey % 5) AS high, p_partkey % 2 = 0 AS closed FROM part),
a AS (SELECT *, version_key('npm', low) AS low_key, version_key('npm', high) AS high_key FROM p)
SELECT normalized_name('PyPI', concat('Pkg__', i.n)) AS name, i.version, a.advisory_id, version_compare('npm', i.version, a.low) AS from_low
FROM i JOIN k ON i.version = k.version JOIN a ON i.n = a.n AND version_affected(k.key, a.low_key, a.high_key, a.closed)
"""


@query(
    """
WITH i AS (SELECT DISTINCT l_partkey % 2000 AS n, [CAST(l_linenumber AS INT), CAST(l_quantity AS INT), CAST(l_suppkey % 10 AS INT)] AS v FROM lineitem),
a AS (SELECT concat('GHSA-', p_partkey) AS advisory_id, p_partkey % 2000 AS n, [CAST(p_size % 4 AS INT), CAST(p_size % 7 AS INT), 0] AS low, [CAST(p_size % 4 + 1 AS INT), CAST(p_size AS INT), CAST(p_partkey % 5 AS INT)] AS high, p_partkey % 2 = 0 AS closed FROM part)
SELECT concat('pkg-', i.n) AS name, concat(v[1], '.', v[2], '.', v[3]) AS version, advisory_id, CAST(v > low AS INT) AS from_low
FROM i JOIN a ON i.n = a.n AND v >= low AND (v < high OR (closed AND v = high))
"""
)
def sql_match(spark, sf_dir):
    """A match in SQL text only."""
    D.views(spark, sf_dir, "lineitem", "part")
    registry.register(spark)
    return spark.sql(_SQL)
