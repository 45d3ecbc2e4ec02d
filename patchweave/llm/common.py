"""Helpers that the operators share: tables in the shared folder, size-checked semi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave import tables
from patchweave.tables import drop_table, new_path, shared_dir  # noqa: F401  (used by the operators)

#: A word of the contracts, in Java's and Python's dialect alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Most ids that are ever broadcast (8 bytes each); larger sides are shuffled.
MAX_BROADCAST_IDS = 1_000_000


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """tables.write_table() in batches that bound what a worker holds."""
    bounded_batches(df.sparkSession)
    return tables.write_table(df, tag)


def with_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", key: str = "doc_id") -> DataFrame:
    """The rows of df whose key is (left_semi) or isn't (left_anti) in ids, a written table; ids is broadcast only where it is counted to be small."""
    ids = ids.select(key).distinct()
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def bounded_batches(spark: SparkSession) -> None:
    """Texts can be long: batches of a thousand rows instead of Spark's ten thousand bound what a worker holds at once. A session that sets its own number keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
