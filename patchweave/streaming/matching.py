"""Advisories as they arrive against an inventory: the last record of each advisory is state, findings are its changes.

Records come in any order. Each key (database, advisory_id) holds when its last record was written, and whether that
one withdraws it; a record that is older than the one held is late news and changes nothing. A withdrawn advisory is
held as a tombstone until the watermark has passed it by KEEP, so that its older records can't bring it back, and then
goes. So the state has one row per advisory that stands, and those lately withdrawn.

The inventory's keys are worked out once, before the stream starts; each batch joins them with the entries that changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from patchweave.operators import matching as M

#: Milliseconds that a tombstone outlives its record.
KEEP = 7 * 86_400_000
#: What a record is: its entries of affected packages as JSON, so that the state's processor needn't know them.
RECORD = "database string, advisory_id string, modified timestamp, withdrawn boolean, entries string"
CHANGE = "database string, advisory_id string, modified timestamp, op string, entries string"
ENTRIES = f"array<struct<aff_ord:int,ecosystem:string,name:string,ranges:{M.RANGES},versions:array<string>,module_stream:string>>"


class LastRecord(StatefulProcessor):
    """Passes on what changes an advisory: 'upsert' with its entries, or 'delete'."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "modified long, withdrawn boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        best: tuple | None = None
        for pdf in rows:
            for modified, withdrawn, entries in zip(pdf["modified"], pdf["withdrawn"], pdf["entries"], strict=True):
                if not pd.isna(modified):
                    # Of two records of one moment the withdrawal counts, then the greater text.
                    best = max(best or (0, False, ""), (int(modified.value // 1000), bool(withdrawn) if withdrawn is not None else False, entries or ""))
        held = self.held.get() if self.held.exists() else None
        if best is None or (held is not None and best[0] <= held[0]):
            return
        modified, withdrawn, entries = best
        self.held.update((modified, withdrawn))
        if withdrawn:
            self.handle.registerTimer(modified // 1000 + KEEP)
        yield pd.DataFrame({"database": [key[0]], "advisory_id": [key[1]], "modified": [pd.Timestamp(modified, unit="us")], "op": ["delete" if withdrawn else "upsert"], "entries": [None if withdrawn else entries]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        """A tombstone's time is over, unless a newer record came or it was withdrawn again later."""
        if self.held.exists():
            modified, withdrawn = self.held.get()
            if withdrawn and modified // 1000 + KEEP <= expiredTimerInfo.getExpiryTimeInMs():
                self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def last_records(records: DataFrame, watermark: str = "7 days") -> DataFrame:
    """CHANGE rows of a stream of RECORD rows. Records without a key or a time are left out."""
    rows = records.filter("database is not null and advisory_id is not null and modified is not null").withWatermark("modified", watermark)
    return rows.groupBy("database", "advisory_id").transformWithStateInPandas(statefulProcessor=LastRecord(), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime", eventTimeColumnName="")


def prepare_inventory(inventory: DataFrame, path: str) -> DataFrame:
    """Writes the packages' names and keys, once for all batches to come."""
    M._keyed_names(inventory).write.mode("overwrite").parquet(path)
    return inventory.sparkSession.read.parquet(path)


def entries_of(changes: DataFrame) -> DataFrame:
    """The entries of changed advisories, as rows of affected."""
    e = changes.filter("op = 'upsert'").select("database", "advisory_id", F.explode(F.from_json("entries", ENTRIES)).alias("e"))
    return e.select("database", "advisory_id", "e.*")


def match_changes(changes: DataFrame, names: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch writes which advisories changed (out/changes) and the packages that their entries hit or leave
    unchecked (out/findings); current_findings() reads what stands. A batch that is run again overwrites its own."""

    def each(batch: DataFrame, batch_id: int) -> None:
        at = f"{out}/changes/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        batch = batch.sparkSession.read.schema(CHANGE).parquet(at)
        ranges = M.write_table(M._keyed_ranges(entries_of(batch)), "stream-ranges")
        M.first_outcomes(M.found_keyed(names, ranges)).write.mode("overwrite").parquet(f"{out}/findings/batch={batch_id}")
        M.drop_table(ranges)

    return changes.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_findings(spark: SparkSession, out: str) -> DataFrame:
    """The findings of each advisory's last change."""
    changed = spark.read.parquet(f"{out}/changes").groupBy("database", "advisory_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/findings").join(changed, ["database", "advisory_id", "batch"], "left_semi").drop("batch")
