"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchweave.plans import derive as D


def report_inputs(spark, sf_dir):
    """findings, skips and targets for the reports, from orders, supplier and customer."""
    o, s = D.table(spark, sf_dir, "orders"), F.col("s_suppkey")
    bands = F.array(*map(F.lit, ["unknown", "none", "low", "medium", "high", "critical"]))
    status = F.col("o_orderstatus")
    findings = o.select(
        (F.col("o_custkey") % 50).alias("target_id"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), (F.col("o_orderkey") % 1000).cast("string")).alias("name"), F.lit("1.0.0").alias("version"), F.concat(F.lit("GHSA-"), F.col("o_orderkey").cast("string")).alias("advisory_id"),
        F.get(bands, (F.floor("o_totalprice").cast("long") % 6).cast("int")).alias("band"), F.lit(5.0).alias("score"), F.when(status == "P", "wont-fix").otherwise("unknown").alias("fix_state"), F.when(status == "F", "2.0.0").otherwise("").alias("fixed"),
        F.array(F.concat(F.lit("GHSA-"), F.col("o_orderkey").cast("string")), F.lit("CVE-1")).alias("identifiers"), F.col("o_orderpriority").startswith("1").alias("kev"), ((F.col("o_orderkey") % 100).cast("double") / 100).alias("max_epss"), F.when(F.col("o_orderkey") % 2 == 0, "a/b.lock").alias("location"),
    )
    skips = D.table(spark, sf_dir, "supplier").select((s % 52).alias("target_id"), F.col("s_name").alias("package"), F.when(s % 3 == 0, "").otherwise("A-1").alias("advisory_id"), F.when(s % 4 == 0, "target").otherwise("coverage").alias("cause"), F.lit("why").alias("reason"))
    lost = F.count_if(F.col("c_nationkey") == 0)
    targets = D.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 52).alias("target_id")).agg(F.count(F.lit(1)).alias("components"), (F.count(F.lit(1)) - lost).alias("cataloged"), lost.alias("skipped_no_version"), F.lit(0).cast("long").alias("skipped_no_purl"), F.bool_and(F.col("c_custkey") % 52 % 7 == 0).alias("eol"))
    return findings, skips, targets
