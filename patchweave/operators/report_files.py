"""Reports as files, one folder per target, written by the executors.

A report is rows: target_id, part, position and line. A line is a piece of the document with its framing (brackets,
commas), so that the lines in order are the document, and no one has to hold it whole: the rows are sorted by range
partitions and written as text, and a target with very many findings is spread over many files, whose order is that of
their names. Which line is a part's first, and so bears no comma, comes from an aggregate that folds before the shuffle.

findings may have, beyond what reporting.py needs: purl, source_name, source_version, layer_digest, matched_name,
summary, upstream (array), range_type, introduced, last_affected, reason, ratings, enrichment. eol: target_id, distro_id,
release, known, eol, maintained, reason.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.operators import reporting as P
from patchweave.operators.matching import small

ORDER = ["target_id", "part", "position"]
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: What a reader has to know where something was left out.
NOT_CLEAN = "no findings, but this is NOT a clean result"


def _some(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column if there is one; empty texts count as none."""
    c = F.col(name) if name in df.columns else F.lit(None).cast(kind)
    return F.nullif(c, F.lit("")) if kind == "string" else c


def _struct_if(there: Column, **fields: Column) -> Column:
    return F.when(there.isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items())))


def _list_if(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def finding_json(f: DataFrame) -> Column:
    """A finding as a JSON text. Fields without a value are left out, but ratings and enrichment are empty lists."""
    package = F.struct(
        F.col("name"), F.col("version"), F.col("ecosystem"), _some(f, "purl").alias("purl"), _struct_if(_some(f, "source_name"), name=_some(f, "source_name"), version=_some(f, "source_version")).alias("source"),
        F.when(_some(f, "location").isNotNull(), F.array(F.struct(F.col("location").alias("path"), _some(f, "layer_digest").alias("layerDigest")))).alias("locations"),
    )
    advisory = F.struct(F.col("advisory_id").alias("id"), _list_if(F.array_remove("identifiers", F.col("advisory_id"))).alias("aliases"), _list_if(_some(f, "upstream", "array<string>")).alias("upstream"), _some(f, "summary").alias("summary"))
    evidence = F.struct(_some(f, "range_type").alias("rangeType"), _some(f, "introduced").alias("introduced"), _some(f, "fixed").alias("fixed"), _some(f, "last_affected").alias("lastAffected"), _some(f, "reason").alias("reason"))
    empty = F.array().cast("array<string>")
    state = lambda r: F.when(F.coalesce(r["fixed"], F.lit("")) != "", "fixed").otherwise(F.coalesce(F.nullif(r["fix_state"], F.lit("")), F.lit("unknown")))
    rating = lambda r: F.struct(
        r["database"].alias("database"), r["advisory_id"].alias("advisoryId"), r["band"].alias("severity"), F.coalesce(r["score"], F.lit(0.0)).alias("score"), F.coalesce(r["fixed"], F.lit("")).alias("fixed"), F.coalesce(r["url"], F.lit("")).alias("url"), state(r).alias("fixState"),
        r["epss"].alias("epss"), r["epss_percentile"].alias("epssPercentile"), r["epss_model"].alias("epssModel"), F.nullif(r["kev"], F.lit(False)).alias("kev"), r["kev_date_added"].alias("kevDateAdded"), F.nullif(r["kev_ransomware"], F.lit(False)).alias("kevRansomware"),
    )
    ratings = F.transform(F.coalesce(F.col("ratings"), F.array().cast(f.schema["ratings"].dataType)), rating) if "ratings" in f.columns and "struct" in f.schema["ratings"].simpleString() else empty
    enrichment = F.coalesce(F.col("enrichment"), F.array().cast(f.schema["enrichment"].dataType)) if "enrichment" in f.columns else empty
    matched = F.coalesce(_some(f, "matched_name"), F.col("name"))
    unfixable = F.coalesce("fixed", F.lit("")) == ""
    return F.to_json(F.struct(package.alias("package"), matched.alias("matchedName"), advisory.alias("advisory"), F.col("band").alias("severity"), F.coalesce("score", F.lit(0.0)).alias("score"), evidence.alias("evidence"), ratings.alias("ratings"), unfixable.alias("unfixable"), F.col("fix_state").alias("fixState"), enrichment.alias("enrichment")))


def _framed(rows: DataFrame) -> DataFrame:
    """rows (ORDER and text) with line: a comma before all but the first of a part. Lines that are all alike are counted
    and made again, so that one of them is the first."""
    told = rows.withColumn("position", F.struct("position.*", F.sha2("text", 256).alias("sha"))).groupBy(*ORDER).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    first = told.groupBy("target_id", "part").agg(F.min("position").alias("__first"))
    each = told.join(small(first), ["target_id", "part"]).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select(*ORDER, F.concat(F.when((F.col("position") == F.col("__first")) & (F.col("i") == 1), "").otherwise(","), "text").alias("line")).withColumn("position", F.struct("position.*", (F.substring("line", 1, 1) == ",").alias("later")))


def _fixed(targets: DataFrame, part: int, line: Column, like: DataFrame) -> DataFrame:
    """A line per target that stands between two parts."""
    return targets.select("target_id", F.lit(part).alias("part"), F.lit(None).cast(like.schema["position"].dataType).alias("position"), line.alias("line"))


def _position(*columns: Column) -> Column:
    """Where a line stands; ties are equal texts."""
    return F.struct(*(F.coalesce(c.cast("string"), F.lit("")).alias(f"p{i}") for i, c in enumerate(columns))).alias("position")


def _finding_rows(findings: DataFrame, part: int, text: Column) -> DataFrame:
    c = [F.col(x) if x in findings.columns else F.lit("") for x in ("ecosystem", "name", "version", "advisory_id", "location")]
    return findings.withColumn("__text", text).select("target_id", F.lit(part).alias("part"), _position(*c), F.col("__text").alias("text"))


def json_lines_of(findings: DataFrame, skips: DataFrame, summary: DataFrame, eol: DataFrame | None = None) -> DataFrame:
    """The JSON reports of all targets of summary: ORDER and line."""
    none = F.lit("")
    f = _framed(_finding_rows(findings, 1, finding_json(findings)))
    skip = F.to_json(F.struct(F.struct(F.col("package").alias("name")).alias("package"), F.nullif("advisory_id", none).alias("advisoryId"), "reason", "cause"))
    k = skips.withColumn("__text", skip).select("target_id", F.lit(3).alias("part"), _position(F.col("package"), F.col("advisory_id"), F.col("reason"), none, none), F.col("__text").alias("text"))
    k = _framed(k)
    totals = F.to_json(F.struct(*(c for c in summary.columns if c != "target_id")))
    last = summary.select("target_id", totals.alias("__s"))
    if eol is not None:
        state = F.to_json(F.struct(F.col("distro_id").alias("distro"), *(c for c in ("release", "known", "eol", "maintained", "reason") if c in eol.columns)))
        last = last.join(eol.select("target_id", state.alias("__e")), "target_id", "left")
    end = F.concat(F.lit('],"summary":'), "__s", F.when(F.col("__e").isNotNull(), F.concat(F.lit(',"eol":'), "__e")).otherwise("") if eol is not None else F.lit(""), F.lit("}"))
    head = _fixed(summary, 0, F.lit(f'{{"schemaVersion":{P.JSON_SCHEMA},"findings":['), f)
    return head.unionByName(f).unionByName(_fixed(summary, 2, F.lit('],"skipped":['), f)).unionByName(k).unionByName(_fixed(last, 4, end, f))


def sarif_lines_of(findings: DataFrame, skips: DataFrame, summary: DataFrame, tool: str = "patchweave", version: str = "1") -> DataFrame:
    """The SARIF reports of all targets of summary: rules by advisory and by cause of a skip, results with those of
    checks that weren't made, and an invocation whose notifications are the packages that weren't evaluated at all."""
    none = F.lit("")
    rules = findings.groupBy("target_id", F.col("advisory_id").alias("rule_id")).agg(F.min(F.struct("ecosystem", "name", "version", F.col("band").alias("band"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("f"))
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.format_string("%.1f", "f.score").alias("security-severity"), F.col("f.band").alias("band")).alias("properties")))
    notes = P.skip_notes(skips)
    kinds = notes.select("target_id", "rule_id").distinct().withColumn("text", F.to_json(F.struct(F.col("rule_id").alias("id"))))
    head_rules = rules.withColumn("text", rule).select("target_id", "rule_id", "text").unionByName(kinds).select("target_id", F.lit(1).alias("part"), _position(F.col("rule_id"), none, none, none, none), "text")
    r = _framed(head_rules)
    results = P.sarif_results(findings)
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation")).alias("physicalLocation"))).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints")))
    note = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message")))
    rows = results.withColumn("text", result).select("target_id", F.lit(3).alias("part"), _position(none, F.col("rule_id"), F.col("uri"), F.col("fingerprint"), none), "text")
    checks = notes.filter("not invocation").withColumn("text", note).select("target_id", F.lit(3).alias("part"), _position(F.lit("~"), F.col("rule_id"), F.col("message"), none, none), "text")
    told = F.to_json(F.struct(F.struct(F.col("rule_id").alias("id")).alias("descriptor"), "level", F.struct(F.col("message").alias("text")).alias("message")))
    whole = notes.filter("invocation").withColumn("text", told).select("target_id", F.lit(5).alias("part"), _position(F.col("rule_id"), F.col("message"), none, none, none), "text")
    body, calls = _framed(rows.unionByName(checks)), _framed(whole)
    names = json.dumps({"name": tool, "version": version})[1:-1]
    head = _fixed(summary, 0, F.lit(f'{{"version":"2.1.0","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":{{{names},"rules":['), r)
    trusted = (F.col("components") == 0) | (F.col("evaluated") > 0)
    call = F.concat(F.lit('],"invocations":[{"executionSuccessful":'), trusted.cast("string"), F.lit(',"toolExecutionNotifications":['))
    return head.unionByName(r).unionByName(_fixed(summary, 2, F.lit("]}},\"results\":["), r)).unionByName(body).unionByName(_fixed(summary, 4, call, r)).unionByName(calls).unionByName(_fixed(summary, 6, F.lit("]}]}]}"), r))


def table_lines_of(findings: DataFrame, skips: DataFrame, summary: DataFrame) -> DataFrame:
    """The text reports of all targets of summary: a line per finding, the counts, what was left out, and, where nothing
    was found but not everything was looked at, that this is no clean result."""
    lines = P.table_lines(findings).select("target_id", F.lit(1).alias("part"), _position(*(F.col(f"position.{c}") for c in ("ecosystem", "name", "version", "advisory_id")), F.col("line")), "line")
    notes = P.skip_notes(skips).select("target_id", F.lit(3).alias("part"), _position(F.col("rule_id"), F.col("message"), *[F.lit("")] * 3), F.concat(F.lit("  "), "message").alias("line"))
    bands = F.concat_ws(", ", *(F.when(F.col(b) > 0, F.format_string(f"%d {b}", b)) for b in (*reversed(P.S.BANDS), "unknown")))
    missed = (F.col("not_evaluated") > 0) | (F.col("incomplete_checks") > 0) | (F.col("target_incomplete") > 0)
    count = F.when(F.col("findings") > 0, F.concat(F.format_string("%d findings: ", "findings"), bands)).when(missed, NOT_CLEAN).otherwise("no findings")
    of = F.format_string("%d of %d components evaluated, %d checks incomplete, %d of the target's entries unread", "evaluated", "components", "incomplete_checks", "target_incomplete")
    p = lines.schema["position"].dataType
    total = summary.select("target_id", F.lit(2).alias("part"), F.lit(None).cast(p).alias("position"), F.concat(count, F.lit("; "), of).alias("line"))
    ended = summary.filter(F.coalesce("eol", F.lit(False))).select("target_id", F.lit(4).alias("part"), F.lit(None).cast(p).alias("position"), F.lit("the distribution's release is past its end of life: it gets no fixes").alias("line"))
    return lines.unionByName(total).unionByName(notes).unionByName(ended)


def write_reports(lines: DataFrame, path: str) -> None:
    """A folder target_id=... of text files for each target; its files, by name, are the report's lines in order."""
    lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("target_id", "line").write.partitionBy("target_id").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """target_id and line of written reports."""
    return spark.read.text(path).select("target_id", F.col("value").alias("line"))
