"""OVAL definitions: criteria trees whose package tests inherit a release and a module gate from the nodes above.

A tree is flattened level by level; tests, objects and states are joined by reference; what a node says of release and
module reaches the tests below it by joins on the prefixes of their paths. A fix is ambiguous where the definitions of
one CVE name several versions for one package, release and stream; all of these are dropped, as none can be trusted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.functions import names as N
from patchweave.operators import matching as M
from patchweave.operators import ranges as R
from patchweave.tables import write_table

_DEFINITION = (
    "_id string, metadata struct<title:string,reference:array<struct<_source:string,_ref_id:string>>,"
    "advisory:struct<severity:string,cve:array<struct<_VALUE:string,_cvss3:string>>>>, criteria string"
)
_NODE = "criterion array<struct<_test_ref:string,_comment:string>>, criteria array<string>"
_TEST = "_id string, object struct<_object_ref:string>, state struct<_state_ref:string>"
#: Builds of other maintenance lines, how a gate's comment and state name a module, and severity words.
_OTHER_LINE = r"(?i)\.ksplice[0-9]+\.|_fips$"
_GATE_COMMENT = r"^Module ([^\s:]+:\S+) is enabled$"
_GATE_STATE = r"stream\\s\*=\\s\*(.+?)\\b"
WORDS = ("Critical", "Important", "Moderate", "Low")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """def_id, advisory_id, title, word, cves, vectors, criteria."""
    d = _xml(spark, path, "definition", _DEFINITION)
    refs = F.coalesce("metadata.reference", F.array().cast("array<struct<_source:string,_ref_id:string>>"))
    of = lambda source: F.transform(F.filter(refs, lambda r: F.lower(r["_source"]) == source), lambda r: F.trim(r["_ref_id"]))
    rated = F.coalesce("metadata.advisory.cve", F.array().cast("array<struct<_VALUE:string,_cvss3:string>>"))
    vectors = F.array_distinct(F.filter(F.transform(rated, lambda c: F.regexp_extract(c["_cvss3"], "^[^/]*/(.*)$", 1)), lambda v: v != ""))
    word = F.initcap(F.trim("metadata.advisory.severity"))
    return d.select(F.col("_id").alias("def_id"), F.get(of("elsa"), F.lit(0)).alias("advisory_id"), F.trim("metadata.title").alias("title"), F.when(word.isin(*WORDS), word).alias("word"), F.array_distinct(of("cve")).alias("cves"), vectors.alias("vectors"), "criteria").filter("advisory_id <> ''")


def criteria(defs: DataFrame) -> DataFrame:
    """def_id, path (of the node, from the root), pos, test_ref, comment of every criterion; nodes without one are kept
    by their children's paths alone."""
    level = defs.select("def_id", F.array().cast("array<int>").alias("path"), F.concat(F.lit("<criteria>"), "criteria", F.lit("</criteria>")).alias("xml")).filter("xml is not null")
    out = None
    while True:
        nodes = write_table(level.select("def_id", "path", F.from_xml("xml", _NODE).alias("n")), "oval-level")
        found = nodes.select("def_id", "path", F.posexplode("n.criterion").alias("pos", "c")).select("def_id", "path", "pos", F.col("c._test_ref").alias("test_ref"), F.col("c._comment").alias("comment"))
        out = found if out is None else out.unionByName(found)
        level = nodes.select("def_id", "path", F.posexplode("n.criteria").alias("i", "xml")).select("def_id", F.concat("path", F.array("i")).alias("path"), "xml")
        if not level.limit(1).count():
            return out


def tests(spark: SparkSession, path: str) -> DataFrame:
    """test_ref with what it tells: package and evr (an earlier build), major (the release), or gate (a module)."""
    plain = _xml(spark, path, "rpminfo_test", _TEST)
    objects = _xml(spark, path, "rpminfo_object", "_id string, name string").select(F.col("_id").alias("object_ref"), F.trim("name").alias("name"))
    states = _xml(spark, path, "rpminfo_state", "_id string, evr struct<_VALUE:string,_operation:string>, version struct<_VALUE:string>")
    states = states.select(F.col("_id").alias("state_ref"), F.when(F.col("evr._operation") == "less than", F.trim("evr._VALUE")).alias("evr"), F.regexp_extract(F.trim("version._VALUE"), r"^\^?([0-9]+)", 1).alias("release"))
    refs = lambda t: t.select(F.col("_id").alias("test_ref"), F.col("object._object_ref").alias("object_ref"), F.col("state._state_ref").alias("state_ref"))
    p = refs(plain).join(objects, "object_ref").join(states, "state_ref").filter("name <> ''")
    is_fix = F.col("evr").isNotNull()
    is_release = ~is_fix & (F.col("name") == "oraclelinux-release") & (F.col("release") != "")
    p = p.filter(is_fix | is_release).select("test_ref", F.when(is_fix, F.col("name")).alias("package"), F.when(is_fix, F.col("evr")).alias("evr"), F.when(is_release, F.col("release").try_cast("int")).alias("major"), F.lit(None).cast("string").alias("module"), F.lit(False).alias("gate"))
    g = refs(_xml(spark, path, "textfilecontent54_test", _TEST))
    files = _xml(spark, path, "textfilecontent54_object", "_id string, filepath string").select(F.col("_id").alias("object_ref"), F.regexp_extract("filepath", r"([^/]+)\.module$", 1).alias("module_name"))
    texts = _xml(spark, path, "textfilecontent54_state", "_id string, text string").select(F.col("_id").alias("state_ref"), F.regexp_replace(F.regexp_extract("text", _GATE_STATE, 1), r"\\(.)", "$1").alias("stream"))
    g = g.join(files, "object_ref", "left").join(texts, "state_ref", "left")
    known = (F.col("module_name") != "") & (F.col("stream") != "")
    null = F.lit(None)
    g = g.select("test_ref", null.cast("string").alias("package"), null.cast("string").alias("evr"), null.cast("int").alias("major"), F.when(known, F.concat_ws(":", "module_name", "stream")).alias("module"), F.lit(True).alias("gate"))
    return p.unionByName(g)


def fixes(found: DataFrame, tested: DataFrame) -> DataFrame:
    """def_id, major, package, stream ('' without a gate), evr. The last release or gate of a node counts for its tests
    and for all below, until a deeper node has its own; tests without a release, and builds of other lines, go."""
    c = found.join(tested, "test_ref")
    stream = F.coalesce("module", F.nullif(F.regexp_extract(F.coalesce("comment", F.lit("")), _GATE_COMMENT, 1), F.lit("")), F.lit(""))
    said = c.groupBy("def_id", "path").agg(F.max_by("major", F.when(F.col("major").isNotNull(), F.col("pos"))).alias("major"), F.max_by(stream, F.when(F.col("gate"), F.col("pos"))).alias("stream"))
    # As many prefixes as the node is deep.
    tested_here = c.filter("package is not null").select("def_id", F.col("path").alias("at"), "package", "evr").distinct()
    above = tested_here.withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), F.size("at")), lambda n: F.slice("at", F.lit(1), n))))
    known = above.join(said, ["def_id", "path"], "left").withColumn("depth", F.size("path"))
    nearest = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("depth")))
    rows = known.groupBy("def_id", "at", "package", "evr").agg(nearest("major").alias("major"), F.coalesce(nearest("stream"), F.lit("")).alias("stream"))
    return rows.filter(F.col("major").isNotNull() & ~F.col("evr").rlike(_OTHER_LINE)).select("def_id", "major", "package", "stream", "evr").distinct()


def drop_ambiguous(rows: DataFrame, keys: list[str], value: str, group: list[str]) -> DataFrame:
    """rows without those whose keys (a CVE, package, release, stream) have more than one value: every group that such
    a key contributes to goes. Counted before the shuffle, an anti join after."""
    several = rows.groupBy(*keys).agg(F.count_distinct(value).alias("n")).filter("n > 1").select(*keys)
    bad = rows.join(several, keys, "left_semi").select(*group).distinct()
    return rows.join(bad, group, "left_anti")


def affected(defs: DataFrame, fixed: DataFrame) -> DataFrame:
    """Affected entries of Oracle Linux, and cves; ambiguous fixes are dropped across definitions."""
    own = F.when(F.size("cves") > 0, F.col("cves")).otherwise(F.array("advisory_id"))
    rows = fixed.join(defs.select("def_id", "advisory_id", "cves", F.explode(own).alias("join_id")), "def_id")
    kept = drop_ambiguous(rows, ["join_id", "major", "package", "stream"], "evr", ["def_id", "major", "package", "stream"])
    one = kept.select("def_id", "advisory_id", "cves", "major", "package", "stream", "evr").distinct()
    null = F.lit(None).cast("string")
    event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"), null.alias("last_affected"), null.alias("limit"))
    ranges = F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(event(F.lit("0"), null), event(null, F.col("evr"))).cast(R.EVENTS).alias("events"), null.alias("fix_state")))
    at = F.row_number().over(Window.partitionBy("advisory_id").orderBy("major", "package", "stream", "def_id")) - 1  # one advisory's packages
    return one.select(N.database_of(F.col("advisory_id")).alias("database"), "advisory_id", at.alias("aff_ord"), F.concat(F.lit("Oracle Linux:"), F.col("major").cast("string")).alias("ecosystem"), F.col("package").alias("name"), ranges.cast(M.RANGES).alias("ranges"), F.array().cast("array<string>").alias("versions"), F.nullif("stream", F.lit("")).alias("module_stream"), "cves")


def read(spark: SparkSession, path: str) -> DataFrame:
    defs = write_table(definitions(spark, path), "oval-definitions")
    return affected(defs, fixes(criteria(defs), tests(spark, path)))
