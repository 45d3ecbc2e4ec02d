"""Advisory and rating feeds as DataFrames: explicit narrow schemas on JSON, CSV and XML readers, then projections.

Each reader takes a path that Spark can list and returns rows in the shape of the store: affected entries (database,
advisory_id, aff_ord, ecosystem, name, ranges, versions, module_stream), ratings (cve, source, ...) or releases. A feed
that yields nothing, or less than it declares, is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.functions import names as N
from patchweave.functions import versions as V
from patchweave.operators import matching as M
from patchweave.operators import ranges as R
from patchweave.operators.telemetry import Drops, drop
from patchweave.sources import archives

#: Databases whose "related" ids name the same vulnerability.
DISTRO_AUTHORED = ("ALPINE", "DEBIAN", "UBUNTU", "RLSA", "ALSA", "ALBA", "ALEA", "CGA")
#: End-of-life catalogue names and the os-release ids that they stand for.
EOL_DISTROS = {"alpine-linux": "alpine", "debian": "debian", "ubuntu": "ubuntu", "rhel": "rhel", "rocky-linux": "rocky", "almalinux": "almalinux", "amazon-linux": "amzn", "oracle-linux": "ol", "fedora": "fedora", "sles": "sles", "opensuse": "opensuse-leap"}

_OSV = (
    "id string, summary string, modified string, withdrawn string, aliases array<string>, upstream array<string>, related array<string>, "
    f"affected array<struct<package:struct<name:string,ecosystem:string,purl:string>,ranges:array<struct<type:string,events:{R.EVENTS}>>,versions:array<string>>>, "
    "severity array<struct<type:string,score:string>>"
)
#: A summary's leading severity word, by which distributions without CVSS vectors rate.
_WORD = "^(Critical|Important|Moderate|Low):"


class FeedError(ValueError):
    """The feed is empty or doesn't hold what it declares."""


def _some(df: DataFrame, what: str) -> DataFrame:
    if not df.limit(1).count():
        raise FeedError(f"{what} yields nothing")
    return df


def osv_records(spark: SparkSession, path: str, drops: Drops | None = None) -> DataFrame:
    """OSV records of a folder of JSON files, as counted_records() gives them."""
    return counted_records(spark.read.schema(_OSV).json(path, multiLine=True), drops)


def osv_archive(spark: SparkSession, path: str, drops: Drops | None = None) -> tuple[DataFrame, DataFrame]:
    """(OSV records of zip or tar archives, of any size; path, member and reason of what in them can't be read)."""
    good, bad = archives.documents(archives.read_archive(spark, path, r".+[.]json"), _OSV)
    return counted_records(good.drop("path", "member"), drops), bad


def same_family(ecosystem: Column, wanted: str) -> Column:
    """Whether an entry belongs to a feed that is read for one ecosystem: its own, with or without a release after a
    colon. Chainguard's packages are built from Wolfi's, so its feed takes both."""
    family = F.split_part(ecosystem, F.lit(":"), F.lit(1))
    return family.isin("Chainguard", "Wolfi") if wanted == "Chainguard" else family == wanted.split(":")[0]


def counted_records(raw: DataFrame, drops: Drops | None = None) -> DataFrame:
    """OSV records that count: not withdrawn, no malware, no plain errata; modified as a timestamp, related ids only of
    distributions' own records; those without a vector are rated by the word that leads their summary."""
    database = N.database_of(F.col("id"))
    r = drop(raw, drops, "records", {"no id": F.col("id").isNull(), "withdrawn": F.coalesce("withdrawn", F.lit("")) != "", "malware": database == "MAL", "errata": database.isin("ALBA", "ALEA")})
    none, unrated = F.array().cast("array<string>"), F.array().cast("array<struct<type:string,score:string>>")
    word = F.regexp_extract(F.coalesce("summary", F.lit("")), _WORD, 1)
    by_word = F.when(database.isin(*DISTRO_AUTHORED) & (word != ""), F.array(F.struct(F.lit("VENDOR_WORD").alias("type"), word.alias("score")))).otherwise(unrated)
    severity = F.coalesce("severity", unrated)
    return r.select(
        database.alias("database"), F.col("id").alias("advisory_id"), "summary", F.try_to_timestamp("modified").alias("modified"),
        F.coalesce("aliases", none).alias("aliases"), F.coalesce("upstream", none).alias("upstream"),
        F.when(database.isin(*DISTRO_AUTHORED), F.coalesce("related", none)).otherwise(none).alias("related"), "affected", F.when(F.size(severity) > 0, severity).otherwise(by_word).alias("severity"),
    )


def _repaired(ranges: str) -> Column:
    """Alpine's bounds written 1.2.r3 are 1.2-r3, where that is a version and what is written is none."""
    one = lambda f: f"get(transform(array(named_struct('v', e.{f}, 'w', regexp_replace(e.{f}, '(?s)^(.*)[.]r', '$1-r'))), p -> case when p.v <> p.w and {V.apk_key('p.v')} is null and {V.apk_key('p.w')} is not null then p.w else p.v end), 0)"
    fields = ", ".join(f"'{f}', {one(f)}" for f in ("introduced", "fixed", "last_affected", "limit"))
    return F.expr(f"transform({ranges}, r -> named_struct('type', r.type, 'events', transform(r.events, e -> named_struct({fields})), 'fix_state', r.fix_state))")


def _stream(summary: str) -> Column:
    """The one name:stream that a summary names; null where it names none or several."""
    rest = F.regexp_replace(F.coalesce(summary, F.lit("")), _WORD + r"[\t\n\f\r ]*", "")
    named = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"[A-Za-z][\w-]*:[A-Za-z0-9][\w.]*"), F.lit(0)))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def osv_affected(records: DataFrame, drops: Drops | None = None, wanted: str | None = None) -> DataFrame:
    """An entry per affected package, of one ecosystem's family if wanted names one: Packagist mirrors fold into Packagist, Ubuntu's lineage keys and GIT ranges go;
    Rocky's and AlmaLinux's entries fixed by a module build have the stream that the summary names."""
    e = records.select("database", "advisory_id", "summary", F.posexplode("affected").alias("aff_ord", "a"))
    eco = F.regexp_replace("a.package.ecosystem", "^Packagist:.+", "Packagist")
    ranges = F.transform(F.filter(F.coalesce("a.ranges", F.array().cast(f"array<struct<type:string,events:{R.EVENTS}>>")), lambda r: r["type"] != "GIT"), lambda r: F.struct(r["type"].alias("type"), r["events"].alias("events"), F.lit(None).cast("string").alias("fix_state")))
    e = e.select("database", "advisory_id", "aff_ord", eco.alias("ecosystem"), F.col("a.package.name").alias("name"), ranges.cast(M.RANGES).alias("ranges"), F.coalesce("a.versions", F.array().cast("array<string>")).alias("versions"), "summary")
    e = e.withColumn("ranges", F.when(F.col("ecosystem").startswith("Alpine"), _repaired("ranges")).otherwise(F.col("ranges")))
    tagged = F.col("ecosystem").rlike("^(Rocky Linux|AlmaLinux)(:|$)") & F.expr("exists(ranges, r -> exists(r.events, e -> e.fixed rlike 'module[+_]el'))")
    e = e.withColumn("module_stream", F.when(tagged, _stream("summary"))).drop("summary")
    lineage = F.col("ecosystem").startswith("Ubuntu") & ~F.col("ecosystem").rlike(V.MAINLINE_UBUNTU)
    other = {} if wanted is None else {"another ecosystem": ~F.coalesce(same_family(F.col("ecosystem"), wanted), F.lit(False))}
    return drop(e, drops, "entries", {"no name": F.coalesce("name", F.lit("")) == "", **other, "a line of its own": F.coalesce(lineage, F.lit(True)), "no range and no version": (F.size("ranges") == 0) & (F.size("versions") == 0)})


_NVD_METRIC = "array<struct<cvssData:struct<vectorString:string>>>"
_NVD = f"totalResults long, vulnerabilities array<struct<cve:struct<id:string,metrics:struct<cvssMetricV2:{_NVD_METRIC},cvssMetricV30:{_NVD_METRIC},cvssMetricV31:{_NVD_METRIC},cvssMetricV40:{_NVD_METRIC}>>>>"


def nvd_ratings(spark: SparkSession, path: str) -> DataFrame:
    """cve, source, vectors; a CVE without a vector has no row."""
    v = spark.read.schema(_NVD).json(path, multiLine=True).select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    of = lambda m, kind: F.transform(F.coalesce(F.col(f"metrics.{m}"), F.array().cast(_NVD_METRIC)), lambda x: F.struct(F.lit(kind).alias("type"), x["cvssData"]["vectorString"].alias("score")))
    vectors = F.filter(F.concat(of("cvssMetricV2", "CVSS_V2"), of("cvssMetricV30", "CVSS_V3"), of("cvssMetricV31", "CVSS_V3"), of("cvssMetricV40", "CVSS_V4")), lambda s: s["score"] != "")
    return v.select(F.col("id").alias("cve"), F.lit("NVD").alias("source"), F.array_distinct(vectors).alias("severity")).filter(F.size("severity") > 0)


def epss_ratings(spark: SparkSession, path: str) -> DataFrame:
    """cve, source, epss, epss_percentile, epss_model; a number that can't be read is an error."""
    head = _some(spark.read.text(path).filter("value like '#%'"), "the EPSS header").select(F.regexp_extract("value", "model_version:([^,]+)", 1)).first()[0]
    rows = spark.read.schema("cve string, epss double, percentile double").csv(path, header=False, comment="#", mode="PERMISSIVE").filter("cve <> 'cve'")
    bad = rows.filter("cve like 'CVE-%' and (epss is null or percentile is null)").limit(1).count()
    if bad:
        raise FeedError("EPSS holds a score that is no number")
    return _some(rows.filter("cve like 'CVE-%'"), "EPSS").select("cve", F.lit("EPSS").alias("source"), "epss", F.col("percentile").alias("epss_percentile"), F.lit(head).alias("epss_model"))


def kev_ratings(spark: SparkSession, path: str) -> DataFrame:
    """cve, source, kev, kev_date_added, kev_ransomware; the declared count has to hold."""
    schema = "count int, vulnerabilities array<struct<cveID:string,dateAdded:string,knownRansomwareCampaignUse:string>>"
    c = _some(spark.read.schema(schema).json(path, multiLine=True), "KEV")
    if c.filter("count is null or count <> size(vulnerabilities)").limit(1).count():
        raise FeedError("KEV does not hold as many entries as it declares")
    v = c.select(F.inline("vulnerabilities"))
    return v.select(F.col("cveID").alias("cve"), F.lit("KEV").alias("source"), F.lit(True).alias("kev"), F.try_to_date("dateAdded", "yyyy-MM-dd").alias("kev_date_added"), (F.lower("knownRansomwareCampaignUse") == "known").alias("kev_ransomware"))


def eol_releases(spark: SparkSession, path: str) -> DataFrame:
    """distro_id, release and its dates as they are written; the declared total has to hold."""
    schema = "total int, result array<struct<name:string,releases:array<struct<name:string,eolFrom:string,eoasFrom:string,eoesFrom:string,isLts:boolean,isMaintained:boolean>>>>"
    c = _some(spark.read.schema(schema).json(path, multiLine=True), "the end-of-life catalogue")
    if c.filter("total is null or total <> size(result)").limit(1).count():
        raise FeedError("the end-of-life catalogue does not hold as many products as it declares")
    ids = F.create_map(*(F.lit(x) for p in EOL_DISTROS.items() for x in p))
    rows = c.select(F.inline("result")).withColumn("distro_id", F.try_element_at(ids, F.col("name"))).filter("distro_id is not null").select("distro_id", F.explode("releases").alias("r"))
    return rows.select("distro_id", F.col("r.name").alias("release"), *(F.coalesce(F.col(f"r.{a}"), F.lit("")).alias(b) for a, b in (("eolFrom", "eol_from"), ("eoasFrom", "eoas_from"), ("eoesFrom", "eoes_from"))), F.col("r.isLts").alias("is_lts"), F.col("r.isMaintained").alias("is_maintained"))


def notices(spark: SparkSession, path: str) -> DataFrame:
    """Of public notices (id, title, content_text) the narrowest for each CVE that they name: that which claims the
    fewest CVEs; title, url and summary follow it."""
    n = spark.read.schema("resList array<struct<id:string,title:string,content_text:string>>").json(path, multiLine=True).select(F.inline("resList"))
    cves = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("(?i)CVE-[0-9]{4}-[0-9]{4,}"), F.lit(0)), F.upper)))
    n = n.withColumn("text", F.concat_ws("\n", "title", "content_text")).withColumn("cves", cves)
    plain = F.trim(F.regexp_replace("content_text", r"\s+", " "))
    rows = n.select(F.explode("cves").alias("cve"), F.size("cves").alias("claims"), F.col("id").alias("notice"), "title", F.substring(plain, 1, 300).alias("summary"))
    return narrowest(rows)


def narrowest(rows: DataFrame) -> DataFrame:
    """For each cve the row that claims the fewest CVEs (none claimed is worst), then the least notice: cve, claims,
    notice and the other columns. Folded before the shuffle."""
    rest = [c for c in rows.columns if c not in ("cve", "claims", "notice")]
    best = F.min(F.struct((F.col("claims") == 0).alias("none"), "claims", "notice", *rest))
    return rows.groupBy("cve").agg(best.alias("b")).select("cve", "b.claims", "b.notice", *(f"b.{c}" for c in rest))


_UPDATE = "_type string, id string, title string, severity string, issued struct<_date:string>, references struct<reference:array<struct<_id:string,_type:string>>>, pkglist struct<collection:struct<package:array<struct<_name:string,_epoch:string,_version:string,_release:string>>>>"


def updateinfo_affected(spark: SparkSession, path: str, ecosystem: str, drops: Drops | None = None) -> DataFrame:
    """updateinfo XML: security updates, each package's first build as the fix. Columns of affected entries, and cves
    and the vendor's word."""
    u = spark.read.format("xml").option("rowTag", "update").schema(_UPDATE).load(path)
    u = drop(u, drops, "updates", {"no id": F.col("id").isNull(), "no security update": F.coalesce("_type", F.lit("")) != "security"})
    first = F.expr("filter(pkglist.collection.package, (p, i) -> array_position(transform(pkglist.collection.package, q -> q._name), p._name) = i + 1)")
    cves = F.array_distinct(F.transform(F.filter(F.coalesce("references.reference", F.array().cast("array<struct<_id:string,_type:string>>")), lambda r: r["_type"] == "cve"), lambda r: r["_id"]))
    e = u.select(N.database_of(F.col("id")).alias("database"), F.col("id").alias("advisory_id"), F.initcap("severity").alias("word"), cves.alias("cves"), F.posexplode(first).alias("aff_ord", "p"))
    evr = F.concat(F.when(F.coalesce("p._epoch", F.lit("0")) != "0", F.concat("p._epoch", F.lit(":"))).otherwise(""), "p._version", F.lit("-"), "p._release")
    null = F.lit(None).cast("string")
    event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"), null.alias("last_affected"), null.alias("limit"))
    ranges = F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(event(F.lit("0"), null), event(null, evr)).alias("events"), null.alias("fix_state")))
    return e.select("database", "advisory_id", "aff_ord", F.lit(ecosystem).alias("ecosystem"), F.col("p._name").alias("name"), ranges.alias("ranges"), F.array().cast("array<string>").alias("versions"), null.alias("module_stream"), "cves", "word")


def delta(changes: DataFrame, snapshot_as_of: str) -> DataFrame:
    """Of a change list (path, changed) what is newer than the snapshot: the last change of each path."""
    return changes.filter(F.col("changed") > F.lit(snapshot_as_of).cast("timestamp")).groupBy("path").agg(F.max("changed").alias("changed"))
