"""Orderings by ecosystem, and the library's functions as SQL functions.

register() gives a session functions that SQL can call. Their bodies are expressions, so Catalyst inlines and optimises
them like any other part of a query; only the orderings without an SQL key (gem, composer) go through Arrow batches.

    comparer_of(ecosystem), normalized_name(ecosystem, name), severity_band(score),
    version_key(ecosystem, version), version_compare(ecosystem, a, b),
    version_affected(key, low, high, closed): whether a key lies in an interval of keys; a null end is none
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from patchweave.functions import names as N
from patchweave.functions import severity as S
from patchweave.functions import versions as V


def orderings(spark: SparkSession) -> DataFrame:
    """The registry as rows: family (of ecosystem keys), comparer, needs_release (a key without a release is none) and
    style: sql (keys are expressions), arrow (keys over Arrow batches)."""
    rows = [(f, c, f in V.NEEDS_RELEASE, "arrow" if c in V.PYTHON else "sql") for c, families in V.FAMILIES.items() for f in families]
    return spark.createDataFrame(rows, "family string, comparer string, needs_release boolean, style string")


def _text(spark: SparkSession, make: Callable[..., Column], **parameters: str) -> str:
    """SQL of an expression over parameters, as Catalyst writes it; only for expressions without lambdas."""
    row = spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in parameters.items()))
    return row.select(make(*(F.col(n) for n in parameters)).alias("x"))._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()


@F.pandas_udf(StringType())
def _arrow_key(comparer: pd.Series, version: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or c not in V.PYTHON else V.PYTHON[c](v) for c, v in zip(comparer, version, strict=True)], dtype=object)


def register(spark: SparkSession) -> list[str]:
    """Puts the functions into the session; their names."""
    spark.udf.register("arrow_version_key", _arrow_key)
    bodies = {
        "comparer_of(ecosystem STRING) RETURNS STRING": _text(spark, V.comparer_of, ecosystem="string"),
        "normalized_name(ecosystem STRING, name STRING) RETURNS STRING": _text(spark, N.normalize_name, ecosystem="string", name="string"),
        "severity_band(score DOUBLE) RETURNS STRING": _text(spark, S.band_of, score="double"),
        "native_version_key(comparer STRING, version STRING) RETURNS STRING": V.native_key("comparer", "version"),
        "version_key(ecosystem STRING, version STRING) RETURNS STRING": "native_version_key(comparer_of(ecosystem), version)",
        "version_compare(ecosystem STRING, a STRING, b STRING) RETURNS INT": "CAST(version_key(ecosystem, a) > version_key(ecosystem, b) AS INT) - CAST(version_key(ecosystem, a) < version_key(ecosystem, b) AS INT)",  # both keys stand twice, and outside of branches: each is worked out once
        "version_affected(key STRING, low STRING, high STRING, closed BOOLEAN) RETURNS BOOLEAN": "(low IS NULL OR key >= low) AND (high IS NULL OR key < high OR (closed AND key = high))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies] + ["arrow_version_key"]
