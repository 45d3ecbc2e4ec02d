"""Summaries, gates and reports of findings, for many targets at once.

findings: target_id, ecosystem, name, version, advisory_id, band, score, fix_state, fixed, identifiers, kev, max_epss,
location. skips: target_id, package, advisory_id (empty for a whole package), cause, reason.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchweave.functions import severity as S
from patchweave.operators.findings import ordered_findings, other_ids, severity_text, sources_disagree


@dataclass(frozen=True)
class Gates:
    """What makes a scan fail; None and False leave a gate open."""

    fail_on: str | None = None
    fail_on_epss: float | None = None
    fail_on_kev: bool = False
    fail_on_unknown: bool = False
    fail_on_unfixable: bool = False
    fail_on_wont_fix: bool = False
    fail_on_eol: bool = False
    fail_on_incomplete: bool = False
    fail_on_incomplete_target: bool = False


def summarise(findings: DataFrame, skips: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target (target_id, components, cataloged, skipped_no_version, skipped_no_purl, eol): counts by band,
    fixes and skips. evaluated: cataloged less packages skipped as a whole; not_evaluated isn't below zero."""
    f = findings.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("findings"),
        *(F.count_if(F.col("band") == b).alias(b) for b in (*S.BANDS, "unknown")),
        F.count_if(F.coalesce("fixed", F.lit("")) == "").alias("unfixable"),
        F.count_if(F.col("fix_state") == "wont-fix").alias("wont_fix"),
        F.count_if("kev").alias("kev"),
        F.max("max_epss").alias("max_epss"),
        F.max(S.band_rank(F.col("band"))).alias("worst"),
    )
    whole = F.coalesce("advisory_id", F.lit("")) == ""
    s = skips.groupBy("target_id").agg(F.count_if(whole).alias("whole_skips"), F.count_if(~whole).alias("incomplete_checks"), F.count_if(F.col("cause") == "target").alias("target_skips"))
    t = targets.join(f, "target_id", "left").join(s, "target_id", "left")
    counts = ["findings", *S.BANDS, "unknown", "unfixable", "wont_fix", "kev", "whole_skips", "incomplete_checks", "target_skips"]
    t = t.fillna(0, counts)
    t = t.withColumn("evaluated", F.col("cataloged") - F.col("whole_skips"))
    t = t.withColumn("not_evaluated", F.greatest(F.lit(0), F.col("components") - F.col("evaluated")))
    return t.withColumn("target_incomplete", F.col("skipped_no_version") + F.col("skipped_no_purl") + F.col("target_skips")).drop("target_skips")


def verdict(g: Gates) -> Column:
    """Exit code of a summary row: 2 where the scan can't be trusted, else 1 where a gate closes, else 0."""
    c, no = F.col, F.lit(False)
    untrusted = (c("components") > 0) & (c("evaluated") <= 0)
    two = untrusted | (F.lit(g.fail_on_incomplete) & ((c("not_evaluated") > 0) | (c("incomplete_checks") > 0))) | (F.lit(g.fail_on_incomplete_target) & (c("target_incomplete") > 0))
    gates = [
        F.lit(g.fail_on_unknown) & (c("unknown") > 0),
        F.lit(g.fail_on_unfixable) & (c("unfixable") > 0),
        F.lit(g.fail_on_wont_fix) & (c("wont_fix") > 0),
        F.lit(g.fail_on_kev) & (c("kev") > 0),
        F.lit(g.fail_on_eol) & F.coalesce("eol", no),
        F.coalesce(c("max_epss") >= g.fail_on_epss, no) if g.fail_on_epss is not None else no,
        F.coalesce(c("worst") >= S.threshold_rank(g.fail_on), no) if g.fail_on else no,
    ]
    one = no
    for x in gates:
        one = one | x
    return F.when(two, 2).when(one, 1).otherwise(0)


def ordered(findings: DataFrame) -> DataFrame:
    return ordered_findings(findings)


#: The JSON report's version, and its lists that are written empty rather than left out.
JSON_SCHEMA = 8
_LISTS = ("ratings", "enrichment")


def json_records(findings: DataFrame, skips: DataFrame, summary: DataFrame) -> DataFrame:
    """target_id, part ('summary', 'finding' or 'skip'), position and a JSON text: the parts of a report in its order.
    A report's writer needs no more than one of them at a time."""
    by = ["ecosystem", "name", "version", "advisory_id"]
    package = F.struct("name", "version", "ecosystem", F.nullif("location", F.lit("")).alias("location"))
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(c), F.array().cast(findings.schema[c].dataType)) if c in findings.columns else empty for c in _LISTS]
    finding = F.struct(package.alias("package"), F.struct(F.col("advisory_id").alias("id"), F.array_remove("identifiers", F.col("advisory_id")).alias("aliases")).alias("advisory"), F.col("band").alias("severity"), F.coalesce("score", F.lit(0.0)).alias("score"), F.struct(F.nullif("fixed", F.lit("")).alias("fixed")).alias("evidence"), *(x.alias(c) for x, c in zip(lists, _LISTS, strict=True)), (F.coalesce("fixed", F.lit("")) == "").alias("unfixable"), F.col("fix_state").alias("fixState"))
    f = findings.select("target_id", F.lit("finding").alias("part"), F.struct(*by, F.coalesce("location", F.lit("")).alias("location")).alias("at"), F.to_json(finding).alias("text"))
    none = F.lit("")
    k = skips.select("target_id", F.lit("skip").alias("part"), F.struct(none.alias("ecosystem"), F.col("package").alias("name"), none.alias("version"), F.coalesce("advisory_id", none).alias("advisory_id"), F.col("reason").alias("location")).alias("at"), F.to_json(F.struct(F.struct(F.col("package").alias("name")).alias("package"), F.nullif("advisory_id", none).alias("advisoryId"), "reason", "cause")).alias("text"))
    s = summary.select("target_id", F.lit("summary").alias("part"), F.struct(*(none.alias(c) for c in ("ecosystem", "name", "version", "advisory_id", "location"))).alias("at"), F.to_json(F.struct(F.lit(JSON_SCHEMA).alias("schemaVersion"), F.struct(*(c for c in summary.columns if c != "target_id")).alias("summary"))).alias("text"))
    return s.unionByName(f).unionByName(k).select("target_id", "part", F.col("at").alias("position"), "text")


def json_document(records: DataFrame, target_id) -> str:
    """One target's report. It is a file for one reader: read row by row on the driver."""
    parts: dict[str, list] = {"summary": [], "finding": [], "skip": []}
    for r in records.filter(F.col("target_id") == F.lit(target_id)).orderBy("part", "position").toLocalIterator():
        parts[r.part].append(json.loads(r.text))
    head = parts["summary"][0] if parts["summary"] else {"schemaVersion": JSON_SCHEMA, "summary": {}}
    return json.dumps({"schemaVersion": head["schemaVersion"], "findings": parts["finding"], "skipped": parts["skip"], "summary": head["summary"]}, indent=2)


def table_lines(findings: DataFrame) -> DataFrame:
    """target_id, position and a line of the text report for each finding: package, version, advisory and other ids,
    severity, fix, and whether its sources disagree."""
    others = other_ids(F.col("advisory_id"), F.col("identifiers"))
    ids = F.concat(F.col("advisory_id"), F.when(F.size(others) > 0, F.concat(F.lit(" ("), F.array_join(others, ", "), F.lit(")"))).otherwise(""))
    fix = F.when(F.coalesce("fixed", F.lit("")) != "", F.col("fixed")).when(F.col("fix_state") == "wont-fix", "won't fix").otherwise("none")
    differ = F.when(sources_disagree("ratings"), "sources disagree").otherwise("") if "ratings" in findings.columns else F.lit("")
    line = F.rtrim(F.concat_ws("  ", F.rpad("name", 24, " "), F.rpad("version", 16, " "), ids, severity_text(F.col("band"), F.col("score")), F.concat(F.lit("fix: "), fix), differ))
    return findings.select("target_id", F.struct("ecosystem", "name", "version", "advisory_id").alias("position"), line.alias("line"))


def skip_notes(skips: DataFrame) -> DataFrame:
    """What a SARIF report says of skips: target_id, rule_id, level 'note', message, and invocation (a notification for
    a whole package) or not (a result for one check)."""
    whole = F.coalesce("advisory_id", F.lit("")) == ""
    text = F.when(whole, F.format_string("%s was not evaluated: %s", "package", "reason")).otherwise(F.format_string("%s was not checked for %s: %s", "package", "advisory_id", "reason"))
    return skips.select("target_id", F.concat(F.lit("skipped-"), "cause").alias("rule_id"), F.lit("note").alias("level"), text.alias("message"), whole.alias("invocation"))


def explain_lines(findings: DataFrame, identifier: str) -> DataFrame:
    """explain() as text: target_id, package, why it is affected and what each rating says."""
    f = explain(findings, identifier)
    ratings = F.array_join(F.transform("ratings", lambda r: F.format_string("%s %s: %s", r["database"], r["advisory_id"], severity_text(r["band"], r["score"]))), "; ") if "ratings" in findings.columns else F.lit("")
    return f.select("target_id", F.format_string("%s %s in %s", "name", "version", "ecosystem").alias("package"), F.coalesce("reason", F.lit("")).alias("why") if "reason" in findings.columns else F.lit("").alias("why"), ratings.alias("ratings"))


def json_lines(findings: DataFrame) -> DataFrame:
    """target_id and a JSON object per finding; absent lists are empty lists."""
    fields = [F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "identifiers" else F.col(c) for c in findings.columns if c != "target_id"]
    return findings.select("target_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("finding"))


def fingerprint(*parts: str) -> Column:
    """A stable hash of what identifies a finding, its parts set off by NUL."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256)


def sarif_results(findings: DataFrame) -> DataFrame:
    """target_id, rule_id, level, message, uri and fingerprint of each finding; the location, else ecosystem and name."""
    level = F.when(F.col("band").isin("critical", "high"), "error").when(F.col("band").isin("low", "none"), "note").otherwise("warning")
    advice = F.when(F.coalesce("fixed", F.lit("")) != "", F.concat(F.lit("fixed in "), "fixed")).otherwise("no fix is recorded")
    return findings.select(
        "target_id",
        F.col("advisory_id").alias("rule_id"),
        level.alias("level"),
        F.format_string("%s %s is affected by %s (%s); %s", "name", "version", "advisory_id", "band", advice).alias("message"),
        F.coalesce(F.nullif("location", F.lit("")), F.concat_ws("/", "ecosystem", "name")).alias("uri"),
        fingerprint("ecosystem", "name", "version", "advisory_id", "location").alias("fingerprint"),
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """A rule per advisory: the first finding in report order gives its band and score."""
    first = F.min(F.struct("ecosystem", "name", "version", "location", "band", "score"))
    return findings.groupBy(F.col("advisory_id").alias("rule_id")).agg(first.alias("f")).select("rule_id", "f.band", "f.score")


def sarif_document(results: DataFrame, rules: DataFrame, tool: str, version: str) -> str:
    """One target's SARIF 2.1.0 text. A report is a file for one reader: it is gathered on the driver."""
    r = [{"id": x.rule_id, "properties": {"security-severity": str(x.score), "band": x.band}} for x in rules.orderBy("rule_id").toLocalIterator()]
    out = [{"ruleId": x.rule_id, "level": x.level, "message": {"text": x.message}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": x.uri}}}], "partialFingerprints": {"primary": x.fingerprint}} for x in results.orderBy("rule_id", "uri", "fingerprint").toLocalIterator()]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": r}}, "results": out}]}, indent=1)


def explain(findings: DataFrame, identifier: str) -> DataFrame:
    """The findings that bear an id."""
    return ordered(findings.filter(F.array_contains("identifiers", identifier) | (F.col("advisory_id") == identifier)))
