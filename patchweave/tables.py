"""Tables in the folder that driver and executors share: how a lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
        where = getattr(spark, "_patchweave_dir", None) or tempfile.mkdtemp(prefix="patchweave-")
        spark._patchweave_dir = where
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/patchweave/{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it again, so a lost executor costs a reread only."""
    path, schema = new_path(df.sparkSession, tag), df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._patchweave_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Deletes a table of write_table that no plan needs any more."""
    path = getattr(df, "_patchweave_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
