"""Package inventories and advisories derived from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: comparer -> (ecosystem, SQL of a version string over integers a, b, c, r, SQL of a list that orders alike).
SHAPES = {
    "semver": ("npm", "concat(a, '.', b, '.', c)", "[a, b, c]"),
    "pep440": ("PyPI", "concat(a, '.', b, case when r % 2 = 0 then concat('rc', c) else concat('.post', c) end)", "[a, b, r % 2, c]"),
    "apk": ("Alpine:v3.19", "concat(a, '.', b, '.', c, '-r', r)", "[a, b, c, r]"),
    "deb": ("Debian:12", "concat(r, ':', a, '.', b, '-', c)", "[r, a, b, c]"),
    "rpm": ("Red Hat:9", "concat(r, ':', a, '.', b, '-', c, '.el9')", "[r, a, b, c]"),
    "nuget": ("NuGet", "concat(a, '.', b, '.', c, '.', r)", "[a, b, c, r]"),
    "gem": ("RubyGems", "concat(a, '.', b, '.', c, '.', r)", "[a, b, c, r]"),
    "composer": ("Packagist", "concat('v', a, '.', b, '.', c)", "[a, b, c]"),
    "maven": ("Maven", "concat(a, '.', b, '.', c)", "[a, b, c]"),
}

#: Distinct installed versions, their numbers, and how many rows of lineitem have them.
INSTALLED = f"""
SELECT concat('pkg-', l_partkey % {NAMES}) AS name, CAST(l_linenumber AS INT) AS a, CAST(l_quantity AS INT) AS b, CAST(l_suppkey % 10 AS INT) AS c, CAST(l_linenumber % 2 AS INT) AS r, count(*) AS installs
FROM lineitem GROUP BY ALL
"""
#: Advisories: the numbers of a lower and of an upper bound, and what kind of upper bound it is.
ADVISORIES = f"""
SELECT concat('GHSA-', p_partkey) AS advisory_id, concat('pkg-', p_partkey % {NAMES}) AS name, CAST(p_partkey % 4 AS INT) AS kind,
  CAST(p_size % 4 AS INT) AS lo_a, CAST(p_size % 7 AS INT) AS lo_b, CAST(p_partkey % 3 AS INT) AS lo_c, CAST(p_size % 2 AS INT) AS lo_r,
  CAST(p_size % 4 + 2 AS INT) AS hi_a, CAST(p_size AS INT) AS hi_b, CAST(p_partkey % 5 AS INT) AS hi_c, CAST(p_partkey % 2 AS INT) AS hi_r
FROM part
"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def _shape(sql: str, prefix: str) -> str:
    """A shape's SQL over prefixed columns."""
    return re.sub(r"\b([abcr])\b(?!')", lambda m: prefix + m[1], sql)


def installed(spark: SparkSession, sf_dir: str, comparer: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(INSTALLED).withColumn("version", F.expr(SHAPES[comparer][1])).select("name", "version", "installs")


def advisories(spark: SparkSession, sf_dir: str, comparer: str) -> DataFrame:
    """kind 0: from the start to a fix; 1: an interval with a fix; 2: with a last affected version; 3: open."""
    views(spark, sf_dir, "part")
    shape = SHAPES[comparer][1]
    rows = spark.sql(ADVISORIES).withColumn("low", F.expr(_shape(shape, "lo_"))).withColumn("high", F.expr(_shape(shape, "hi_")))
    none = F.lit(None).cast("string")
    event = lambda **k: F.struct(*(k.get(n, none).alias(n) for n in ("introduced", "fixed", "last_affected", "limit")))
    first = event(introduced=F.when(F.col("kind") == 0, "0").otherwise(F.col("low")))
    fixed, last = event(fixed=F.col("high")), event(last_affected=F.col("high"))
    events = F.when(F.col("kind") < 2, F.array(first, fixed)).when(F.col("kind") == 2, F.array(last, first)).otherwise(F.array(first))
    return rows.select("advisory_id", "name", events.alias("events"))


def match_sql(comparer: str) -> str:
    """The twin of a match: interval tests on lists of integers."""
    shape, order = SHAPES[comparer][1:]
    v, lo, hi = order, _shape(order, "lo_"), _shape(order, "hi_")
    return f"""
WITH i AS ({INSTALLED}), a AS ({ADVISORIES}),
x AS (SELECT i.name, {shape} AS version, installs, advisory_id, kind, {_shape(shape, "lo_")} AS low, {_shape(shape, "hi_")} AS high,
  kind = 0 OR {v} >= {lo} AS above, {v} < {hi} AS below, {v} <= {hi} AS upto, {hi} >= {lo} AS forward, {hi} > {lo} AS upward
  FROM i JOIN a USING (name))
SELECT name, version, advisory_id, installs,
  CASE WHEN kind < 2 AND (kind = 0 OR upward) THEN high END AS fixed,
  CASE WHEN kind = 2 AND forward THEN high END AS last_affected
FROM x WHERE CASE kind WHEN 0 THEN below WHEN 1 THEN above AND (below OR NOT forward) WHEN 2 THEN above AND (upto OR NOT forward) ELSE above END
"""
