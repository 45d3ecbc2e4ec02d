"""What is left out, counted by reason in the pass that leaves it out.

A feed that drops records silently looks complete. drop() sets rows aside by the first reason that holds, and counts
all rows and each reason as metrics of the same job (DataFrame.observe), so counting costs no second read. The counts
are there once an action has run over the result; provenance() makes them rows for the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PROVENANCE = "source string, step string, read long, kept long, dropped map<string,long>"


class Drops:
    """The counts of one source, step by step."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.steps: list[tuple[str, list[str], Observation]] = []

    def drop(self, df: DataFrame, step: str, reasons: dict[str, Column]) -> DataFrame:
        """df without the rows for which a reason holds; the first one that does is counted. A null condition is false."""
        why = F.lit(None).cast("int")
        for i, condition in reversed(list(enumerate(reasons.values()))):
            why = F.when(F.coalesce(condition, F.lit(False)), i).otherwise(why)
        seen = Observation()
        counted = df.withColumn("__why", why).observe(seen, F.count(F.lit(1)).alias("read"), *(F.count_if(F.col("__why") == i).alias(f"r{i}") for i in range(len(reasons))))
        self.steps.append((step, list(reasons), seen))
        return counted.filter("__why is null").drop("__why")

    def counts(self) -> list[tuple[str, str, int, int, dict[str, int]]]:
        """Rows of PROVENANCE. Waits for the action that reads the result; without any it would wait for ever."""
        out = []
        for step, reasons, seen in self.steps:
            got = seen.get
            dropped = {r: got[f"r{i}"] for i, r in enumerate(reasons)}
            out.append((self.source, step, got["read"], got["read"] - sum(dropped.values()), dropped))
        return out


def drop(df: DataFrame, drops: Drops | None, step: str, reasons: dict[str, Column]) -> DataFrame:
    """Drops.drop(), or a plain filter where nothing is counted."""
    return drops.drop(df, step, reasons) if drops else df.filter(~_any(reasons))


def _any(reasons: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in reasons.values():
        out = out | F.coalesce(c, F.lit(False))
    return out


def provenance(spark: SparkSession, *drops: Drops) -> DataFrame:
    """The counts of several sources as rows, a few for each."""
    return spark.createDataFrame([r for d in drops for r in d.counts()], PROVENANCE)


def dropped(provenance_rows: DataFrame) -> DataFrame:
    """source, step, reason, n: a row for each reason that any row was dropped for."""
    return provenance_rows.select("source", "step", F.explode("dropped").alias("reason", "n")).filter("n > 0")
