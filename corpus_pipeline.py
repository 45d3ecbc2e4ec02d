"""The corpus pipeline: five stages, each over all that its predecessor kept.

toxicity (documents it rejects go) -> exact dedup -> MinHash near-dedup (one document of each group stays) -> mixing
sources to target weights (texts as often and as far as the mix takes them) -> packing into sequences.

All stages but the last return the columns of documents, further columns included. Defined results: a null text is an
empty one; it is never toxic, all empty texts are one text for exact dedup (the row with the largest doc_id stays), and
of an empty text the mix takes nothing, so it ends there. Rows without doc_id pass each stage, decided by their text:
of equal texts one row stays, a row with an id before one without. A null source is a source of its own. Rows that
repeat are one row after exact dedup; ties are broken by doc_id, then by a digest of the text. An empty table gives an
empty result. Texts are whole at every stage, however long; only the mix cuts them, to the words that it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchweave.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from patchweave.llm.common import bounded_batches, documents, write_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal model, trained on the given labels, calls toxic."""
    bounded_batches(spark)
    return toxicity.keep_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return near_dedup.keep_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time a document is taken, its text cut to the words taken."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a sequence."""
    return packing.digests(packing.pack(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained model, MinHash and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
