"""CSAF VEX documents of Red Hat and SUSE: product trees and statuses as joins, an advisory per CVE.

documents: doc (unique, as its path) and text, a document's JSON. A tree's branches nest without bound, so they are
read level by level; everything else is one pass. Both vendors share the pipeline and differ in how a product id is
resolved to (ecosystem, package, stream, fixed version).

Affected entries have the store's columns; ranges: one per fixed version in ascending order, then an open one with a
fix state where the vendor names an affected product without a fix. Products that can't be resolved are counted by
reason in skipped(), never read as unaffected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.functions import names as N
from patchweave.operators import matching as M
from patchweave.operators import ranges as R
from patchweave.tables import write_table

_BRANCHES = "array<struct<category:string,product:struct<product_id:string,product_identification_helper:struct<cpe:string,purl:string>>,branches:string>>"
_DOCUMENT = (
    "document struct<tracking:struct<id:string>,title:string>, product_tree struct<branches:string>, vulnerabilities array<struct<cve:string,"
    "product_status:struct<fixed:array<string>,recommended:array<string>,known_affected:array<string>>,"
    "remediations:array<struct<category:string,product_ids:array<string>>>,"
    "scores:array<struct<cvss_v3:struct<vectorString:string>,cvss_v4:struct<vectorString:string>>>>>"
)
#: Architectures that end a product id, Red Hat's main platforms, SUSE's platform names and package URLs.
_ARCHES = "[.](x86_64|aarch64|ppc64le|s390x|ppc64|i686|noarch|src|i386|ia64|ppc|s390|armv7hl)$"
_MAINLINE = r"^cpe:/[oa]:redhat:enterprise_linux:([0-9]+)(?:\.[0-9]+)?(?:::.*)?$"
_TUMBLEWEED = "openSUSE Tumbleweed"
_SERVER = "^SUSE Linux Enterprise Server ([0-9]+)(?: SP([0-9]+))?$"
_SERVER_DOTTED = "^SUSE Linux Enterprise Server ([0-9]+)[.]([0-9]+)$"
_MODULE = "^SUSE Linux Enterprise Module for [A-Za-z0-9 ]+ ([0-9]+)(?: SP([0-9]+))?$"
_LEAP = "^openSUSE Leap ([0-9]+[.][0-9]+)$"
_SUSE_PURL = "^pkg:rpm/suse/([^@]+)@([^?]*)"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def parsed(documents: DataFrame) -> DataFrame:
    """doc, cve, title, branches, vulnerabilities; documents about no CVE are left out."""
    d = documents.select("doc", F.from_json("text", _DOCUMENT).alias("d")).select("doc", "d.*")
    cve = F.coalesce(F.nullif(F.get("vulnerabilities", F.lit(0))["cve"], F.lit("")), F.col("document.tracking.id"))
    return d.select("doc", cve.alias("cve"), F.col("document.title").alias("title"), F.col("product_tree.branches").alias("branches"), "vulnerabilities").filter("cve like 'CVE-%'")


def products(rows: DataFrame) -> DataFrame:
    """doc, category, product_id, cpe, purl of every product of the trees, whatever their depth."""
    level, out = rows.select("doc", "branches").filter("branches is not null"), None
    while True:
        nodes = write_table(level.select("doc", F.explode(F.from_json("branches", _BRANCHES)).alias("b")), "csaf-level")
        found = nodes.filter("b.product is not null").select("doc", "b.category", "b.product.product_id", F.col("b.product.product_identification_helper.cpe").alias("cpe"), F.col("b.product.product_identification_helper.purl").alias("purl"))
        out = found if out is None else out.unionByName(found)
        level = nodes.filter("b.branches is not null").select("doc", F.col("b.branches").alias("branches"))
        if not level.limit(1).count():
            return out


def statuses(rows: DataFrame, fixed_field: str) -> DataFrame:
    """doc, cve, kind ('fixed', 'affected', 'no_fix_planned' or 'none_available'), product: a row per mention."""
    v = rows.select("doc", "cve", F.explode("vulnerabilities").alias("v"))
    none = F.array().cast("array<string>")
    tagged = lambda ids, kind: F.transform(F.coalesce(ids, none), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("product")))
    remedy = lambda kind: F.flatten(F.transform(F.filter(F.coalesce("v.remediations", F.array().cast("array<struct<category:string,product_ids:array<string>>>")), lambda r: r["category"] == kind), lambda r: F.coalesce(r["product_ids"], none)))
    all_of = F.concat(tagged(F.col(f"v.product_status.{fixed_field}"), "fixed"), tagged(F.col("v.product_status.known_affected"), "affected"), *(tagged(remedy(k), k) for k in ("no_fix_planned", "none_available")))
    ids = v.select("doc", "cve", F.explode(all_of).alias("x")).select("doc", "cve", "x.kind", "x.product").distinct()
    colon = F.instr("product", ":")
    has = colon > 0
    return ids.withColumns({"platform": F.when(has, F.substring_index("product", ":", 1)), "component": F.when(has, F.substr("product", colon + 1))})


def _redhat(mentions: DataFrame, tree: DataFrame) -> DataFrame:
    """mentions with ecosystem, name, stream, evr and why (null where the product counts)."""
    cpe = tree.filter("cpe <> ''").groupBy("doc", F.col("product_id").alias("platform")).agg(F.max("cpe").alias("cpe"))
    m = mentions.join(cpe, ["doc", "platform"], "left")
    major = F.regexp_extract(F.coalesce("cpe", F.lit("")), _MAINLINE, 1)
    context = F.when(F.contains("component", F.lit("::")), F.regexp_extract("component", "^.*?::(.*)$", 1)).otherwise("")
    item = N.nevra(F.regexp_replace(F.regexp_extract("component", "^(.*?)(?:::.*)?$", 1), _ARCHES, ""))
    m = m.withColumns({"context": context, "item": item})
    c = F.col
    why = (
        F.when(c("component").isNull(), "whole product").when(c("component") == "", "bad product").when(F.contains("component", F.lit("@sha256:")), "image")
        .when(c("cpe").isNull(), "no platform").when(major == "", "other platform").when(c("context").endswith(":flatpak"), "flatpak")
        .when((c("context") != "") & ~c("context").rlike("^[^:]+:.+$"), "module context").when(c("item.name") == "", "bad product")
        .when((c("context") == "") & c("item.evr").rlike("module[+_]el"), "module build")
    )
    return m.select(*mentions.columns, F.concat(F.lit("Red Hat:"), major).alias("ecosystem"), F.col("item.name").alias("name"), F.nullif("context", F.lit("")).alias("stream"), F.col("item.evr").alias("evr"), why.alias("why"))


def suse_key(platform: Column) -> Column:
    """The ecosystem key of a SUSE platform's name; null for those that aren't keyed."""
    x = lambda p, i: F.regexp_extract(platform, p, i)
    sles = lambda p: F.concat(F.lit("SLES:"), x(p, 1), F.when(x(p, 2).isin("", "0"), "").otherwise(F.concat(F.lit(".SP"), x(p, 2))))
    return (
        F.when(platform.rlike(_SERVER), F.when(x(_SERVER, 1).try_cast("int") < 16, sles(_SERVER)))
        .when(platform.rlike(_SERVER_DOTTED), F.concat(F.lit("SLES:"), x(_SERVER_DOTTED, 1), F.lit("."), x(_SERVER_DOTTED, 2)))
        .when(platform.rlike(_MODULE), sles(_MODULE))
        .when(platform.rlike(_LEAP), F.concat(F.lit("openSUSE Leap:"), x(_LEAP, 1)))
    )


def _suse(mentions: DataFrame, tree: DataFrame) -> DataFrame:
    declared = tree.filter("category = 'product_name'").select("doc", F.col("product_id").alias("platform")).distinct().withColumn("declared", F.lit(True))
    package = tree.filter(F.col("category") == "product_version").filter(F.col("purl").rlike(_SUSE_PURL))
    package = package.groupBy("doc", F.col("product_id").alias("component")).agg(F.max("purl").alias("purl"))
    m = mentions.join(declared, ["doc", "platform"], "left").join(package, ["doc", "component"], "left").withColumn("key", suse_key(F.col("platform")))
    c = F.col
    why = (
        F.when(c("component").isNull(), "whole product").when(c("component") == "", "bad product").when(c("platform") == _TUMBLEWEED, "rolling release")
        .when(c("declared").isNull(), "no platform").when(c("key").isNull(), "other platform").when(c("purl").isNull(), "no package")
    )
    return m.select(*mentions.columns, c("key").alias("ecosystem"), F.regexp_extract("purl", _SUSE_PURL, 1).alias("name"), F.lit(None).cast("string").alias("stream"), F.regexp_extract("purl", _SUSE_PURL, 2).alias("evr"), why.alias("why"))


_VENDORS = {"REDHAT": ("fixed", _redhat), "SUSE": ("recommended", _suse)}


def mentions(documents: DataFrame, vendor: str) -> DataFrame:
    """Every product that a document mentions, resolved: doc, cve, kind, product, ecosystem, name, stream, evr, why."""
    field, resolve = _VENDORS[vendor]
    rows = parsed(documents)
    return resolve(statuses(rows, field), products(rows)).drop("platform", "component")


def skipped(resolved: DataFrame) -> DataFrame:
    """How many status mentions count for nothing, by reason."""
    return resolved.filter("why is not null and kind in ('fixed', 'affected')").groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def evr_sets(resolved: DataFrame) -> DataFrame:
    """cve, ecosystem, name, module_stream, fixed (its distinct fixed versions in ascending order), open (named as
    affected, or fixed without a version), fix_state of the open part. Folded before the shuffle."""
    r = resolved.filter("why is null")
    is_fix = (F.col("kind") == "fixed") & (F.col("evr") != "")
    said = lambda k: F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False))
    g = r.groupBy("cve", "ecosystem", "name", F.col("stream").alias("module_stream")).agg(
        F.array_sort(F.collect_set(F.when(is_fix, F.col("evr")))).alias("fixed"),  # the fixed builds of one package
        F.coalesce(F.bool_or(~is_fix & F.col("kind").isin("fixed", "affected")), F.lit(False)).alias("open"),
        said("no_fix_planned").alias("never"), said("none_available").alias("pending"),
    )
    state = F.when(F.col("open"), F.when(F.col("never"), "wont-fix").when(F.col("pending"), "not-fixed").otherwise("unknown"))
    return g.filter((F.size("fixed") > 0) | F.col("open")).select("cve", "ecosystem", "name", "module_stream", "fixed", "open", state.alias("fix_state"))


def affected(documents: DataFrame, vendor: str) -> DataFrame:
    """Affected entries: database is the vendor, advisory_id the CVE; entries of one CVE are numbered by key."""
    sets = evr_sets(mentions(documents, vendor))
    null = F.lit(None).cast("string")
    event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"), null.alias("last_affected"), null.alias("limit"))
    one = lambda events, state: F.struct(F.lit("ECOSYSTEM").alias("type"), events.cast(R.EVENTS).alias("events"), state.alias("fix_state"))
    start = event(F.lit("0"), null)
    closed = F.transform("fixed", lambda v: one(F.array(start, event(null, v)), null))
    opened = F.when(F.col("open"), F.array(one(F.array(start), F.col("fix_state")))).otherwise(F.array().cast(M.RANGES))
    # The entries of one CVE are as many as its products: a bounded window.
    at = F.row_number().over(Window.partitionBy("cve").orderBy("ecosystem", "name", "module_stream")) - 1
    return sets.select(F.lit(vendor).alias("database"), F.col("cve").alias("advisory_id"), at.alias("aff_ord"), "ecosystem", "name", F.concat(closed.cast(M.RANGES), opened).alias("ranges"), F.array().cast("array<string>").alias("versions"), "module_stream")


def severities(documents: DataFrame) -> DataFrame:
    """cve and its distinct vectors, version 4 before version 3 of each score."""
    s = parsed(documents).select("cve", F.explode("vulnerabilities").alias("v")).select("cve", F.posexplode("v.scores").alias("i", "s"))
    both = F.array(F.struct(F.lit("CVSS_V4").alias("type"), F.col("s.cvss_v4.vectorString").alias("score")), F.struct(F.lit("CVSS_V3").alias("type"), F.col("s.cvss_v3.vectorString").alias("score")))
    one = s.select("cve", "i", F.posexplode(both).alias("j", "x")).filter("x.score <> ''").groupBy("cve", "x").agg(F.min(F.struct("i", "j")).alias("at"))
    return one.groupBy("cve").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda y: y["x"]).alias("severity"))
