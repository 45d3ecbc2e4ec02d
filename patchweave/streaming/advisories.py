"""Advisories as a stream: records that arrive in a folder, deduplicated, kept by key, and matched against an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patchweave.operators import matching as M
from patchweave.operators.incremental import last_writes


def read_stream(spark: SparkSession, path: str, schema: str, watermark: str = "7 days") -> DataFrame:
    """New JSON records of a folder, each (database, advisory_id, modified) once within the watermark."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.withWatermark("modified", watermark).dropDuplicatesWithinWatermark(["database", "advisory_id", "modified"])


def buckets(batch: DataFrame, keys: tuple[str, ...], number: int) -> DataFrame:
    return batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(number)).cast("int"))


def upsert(stream: DataFrame, table_path: str, checkpoint: str, keys: tuple[str, ...] = ("database", "advisory_id"), number: int = 64) -> StreamingQuery:
    """Keeps table_path at the last record of each key. The table is split into buckets of keys; a batch rewrites the
    buckets that it touches and no others, each as a folder of its own batch, and drops the folder that it replaces. A
    batch that is run again reads what was there before it and writes the same. Read it with current()."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = buckets(batch, keys, number)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most number
        versions = {b: v for b, v in _versions(spark, table_path, below=batch_id).items() if b in touched}
        if versions:
            held = [f"{table_path}/bucket={b}/v={v}" for b, v in sorted(versions.items())]
            rows = rows.unionByName(buckets(spark.read.schema(batch.schema).parquet(*held), keys, number))
        fresh = last_writes(rows, [*keys, "bucket"], "modified").withColumn("v", F.lit(batch_id))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(table_path)
        for b, v in _versions(spark, table_path, below=batch_id - 1).items():
            if b in touched:
                _delete(spark, f"{table_path}/bucket={b}/v={v}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _versions(spark: SparkSession, table_path: str, below: int | None = None) -> dict[int, int]:
    """The last version of each bucket, before a batch."""
    p, fs = _path(spark, f"{table_path}/bucket=*/v=*")
    out: dict[int, int] = {}
    for f in fs.globStatus(p) or []:
        b, v = int(f.getPath().getParent().getName()[7:]), int(f.getPath().getName()[2:])
        if below is None or v < below:
            out[b] = max(v, out.get(b, -1))
    return out


def current(spark: SparkSession, table_path: str, schema: str) -> DataFrame:
    """The table as of its last batch."""
    held = [f"{table_path}/bucket={b}/v={v}" for b, v in sorted(_versions(spark, table_path).items())]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def match_stream(affected: DataFrame, inventory: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Affected entries as they arrive against a static inventory: each micro-batch appends the packages that its
    entries hit or leave unchecked (matching.first_outcomes) to out. A batch that is run again overwrites its own."""

    def each(batch: DataFrame, batch_id: int) -> None:
        found = M.first_outcomes(M.outcomes(M.candidates(inventory, batch)))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return affected.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
