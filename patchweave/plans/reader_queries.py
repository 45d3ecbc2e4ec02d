"""Queries of the readers: files and feeds whose texts Spark writes from the tables, read back, each with its SQL twin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.plans import derive as D
from patchweave.plans.registry import query
from patchweave.sources import feeds, inventory
from patchweave.tables import new_path

#: Format -> (file name, head, a package's text with {n} and {v}, what stands between two, foot, ecosystem (null: placed
#: later, by the distribution), name and version that are read, in SQL over n and v).
_LOCKS = {
    "npm": ("package-lock.json", '{"lockfileVersion":3,"packages":{"":{"name":"root","version":"1"},', '"node_modules/{n}":{"version":"{v}"}', ",", "}}", "npm", "n", "v"),
    "yarn": ("yarn.lock", "# yarn lockfile v1\n\n", '"{n}@^1.0.0", "{n}@^1":\n  version "{v}"\n  resolved "x"\n', "\n", "\n", "npm", "n", "v"),
    "poetry": ("poetry.lock", "", '[[package]]\nname = "{n}"\nversion = "{v}"\n', "\n", "", "PyPI", "n", "v"),
    "uv": ("uv.lock", "version = 1\n", '[[package]]\nname = "{n}"\nversion = "{v}"\n', "\n", "", "PyPI", "n", "v"),
    "cargo": ("Cargo.lock", "version = 3\n", '[[package]]\nname = "{n}"\nversion = "{v}"\nsource = "registry+https://x"\n', "\n", "", "crates.io", "n", "v"),
    "pipfile": ("Pipfile.lock", '{"default":{', '"{n}":{"version":"=={v}"}', ",", '},"develop":{}}', "PyPI", "n", "v"),
    "gem": ("Gemfile.lock", "GEM\n  remote: https://rubygems.org/\n  specs:\n", "    {n} ({v})\n      rake (>= 1)", "\n", "\n\nPLATFORMS\n  ruby\n", "RubyGems", "n", "v"),
    "composer": ("composer.lock", '{"packages":[', '{"name":"v/{n}","version":"{v}"}', ",", '],"packages-dev":[{"name":"v/dev","version":"dev-main"}]}', "Packagist", "concat('v/', n)", "v"),
    "nuget": ("packages.lock.json", '{"version":1,"dependencies":{"net6.0":{', '"{n}":{"type":"Direct","resolved":"{v}"}', ",", "}}}", "NuGet", "n", "v"),
    "gomod": ("go.mod", "module example.com/m\n\ngo 1.21\n\nrequire (\n", "\texample.com/{n} v{v} // indirect", "\n", "\n)\n", "Go", "concat('example.com/', n)", "concat('v', v)"),
    "apk": ("installed", "", "C:Q1x\nP:{n}\nV:{v}-r0\nA:x86_64", "\n\n", "\n\n", None, "n", "concat(v, '-r0')"),
    "dpkg": ("status", "", "Package: {n}\nStatus: install ok installed\nArchitecture: amd64\nVersion: {v}-1", "\n\n", "\n\n", None, "n", "concat(v, '-1')"),
    "spdx": ("x.spdx.json", '{"spdxVersion":"SPDX-2.3","packages":[', '{"SPDXID":"SPDXRef-{n}","name":"{n}","versionInfo":"{v}","externalRefs":[{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":"pkg:npm/{n}@{v}"}]}', ",", '],"relationships":[]}', "npm", "n", "v"),
    "cyclonedx": ("bom.json", '{"bomFormat":"CycloneDX","specVersion":"1.5","components":[{"type":"operating-system","name":"debian","version":"12"},', '{"type":"library","name":"{n}","version":"{v}","purl":"pkg:npm/{n}@{v}"}', ",", "]}", "npm", "n", "v"),
}
_ROWS = "SELECT p_partkey % 40 AS f, concat('pkg-', p_partkey) AS n, concat(p_size, '.', p_partkey % 10, '.', p_partkey % 7) AS v FROM part"


def _read(spark, sf_dir: str, kind: str) -> DataFrame:
    """Forty files of one format, read."""
    name, head, each, between, foot, *_ = _LOCKS[kind]
    D.views(spark, sf_dir, "part")
    # The template's pieces, in turn with the names and versions that stand between them.
    text = F.concat(*(F.col(x[1]) if x in ("{n}", "{v}") else F.lit(x) for x in re.split(r"(\{[nv]\})", each) if x))
    files = spark.sql(_ROWS).groupBy("f").agg(F.array_sort(F.collect_list(text)).alias("t"))
    content = F.concat(F.lit(head), F.array_join("t", between), F.lit(foot)).cast("binary")
    return inventory.parse_files(files.select(F.concat(F.lit("/x/"), F.col("f").cast("string"), F.lit(f"/{name}")).alias("path"), content.alias("content")))


def _lock_sql(kind: str) -> str:
    name, _, _, _, _, eco, n, v = _LOCKS[kind]
    return f"WITH r AS ({_ROWS}) SELECT concat('/x/', f, '/{name}') AS path, '{kind}' AS kind, {'NULL' if eco is None else repr(eco)} AS ecosystem, {n} AS name, {v} AS version FROM r"


for _k in _LOCKS:
    query(_lock_sql(_k), f"read_{_k}")(lambda spark, sf_dir, k=_k: _read(spark, sf_dir, k).filter("reason is null").select("path", "kind", "ecosystem", "name", "version"))


#: A distribution of each document: ID, VERSION_ID, PRETTY_NAME, and its key (null: none that advisories are keyed by).
_SYSTEMS = [("alpine", "3.19.1", "Alpine Linux v3.19", "Alpine:v3.19"), ("rhel", "9.4", "Red Hat Enterprise Linux 9.4", "Red Hat:9"), ("ubuntu", "22.04", "Ubuntu 22.04.4 LTS", "Ubuntu:22.04:LTS"), ("debian", "12", "Debian GNU/Linux 12", "Debian:12"), ("plan9", "4", "Plan 9", None), (None, None, None, None)]
_DOCUMENTS = f"""
WITH s AS (SELECT * FROM (VALUES {", ".join(str((i, *x)).replace("None", "CAST(NULL AS STRING)") for i, x in enumerate(_SYSTEMS))}) AS t(d, id, version, pretty, key)),
p AS (SELECT p_partkey % 60 AS f, p_partkey % 6 AS d, CAST(floor(p_partkey / 6) AS BIGINT) % 9 AS c, p_partkey AS k, p_size AS z FROM part)
"""


def _sbom_parts(spark, sf_dir: str) -> DataFrame:
    """Parts dealt to documents (f) of six distributions (d), and to nine kinds of components (c)."""
    D.views(spark, sf_dir, "part")
    return spark.sql(f"{_DOCUMENTS} SELECT p.*, id, s.version AS os_version, pretty FROM p JOIN s USING (d)")


def _cyclonedx_files(spark, sf_dir: str) -> DataFrame:
    """CycloneDX documents whose system is the last component, as inventory tools write them."""
    property_ = lambda name, value: f"""'{{"name":"syft:{name}","value":"', {value}, '"}}'"""
    component = f"""concat('{{"type":"', case when c = 8 then 'file' else 'library' end, '","name":"n', k, '","version":"', case when c = 7 then '' else concat('0.', z) end, '"',
  case c when 0 then concat(',"purl":"pkg:apk/alpine/n', k, '@1.', z, '-r0?arch=x86_64"') when 1 then concat(',"purl":"pkg:rpm/redhat/n', k, '@1.', z, '-1.el9?arch=x86_64&epoch=2&upstream=src', k, '-1.', z, '-1.el9.src.rpm"')
    when 2 then concat(',"purl":"pkg:deb/debian/n', k, '@1.', z, '-1?arch=amd64&distro=debian-11"') when 3 then concat(',"purl":"pkg:npm/%40s/n', k, '"') when 4 then ',"purl":"pkg:rpm/redhat/gpg-pubkey@1-1"' when 5 then '' when 6 then concat(',"purl":"pkg:swift/n', k, '@1"')
    when 7 then concat(',"purl":"pkg:npm/n', k, '"') else concat(',"purl":"pkg:npm/n', k, '@1"') end,
  ',"properties":[', {property_("location:0:path", "'/db/', k")}, ',', {property_("metadata:originPackage", "'origin', k")}, ',', {property_("metadata:modularityLabel", "'mod:', z, ':8030:abc'")}, ']}}')"""
    system = f"""case when id is null then '' else concat(',{{"type":"operating-system","name":"x","version":"0","properties":[', {property_("distro:id", "id")}, ',', {property_("distro:versionID", "os_version")}, ',', {property_("distro:prettyName", "pretty")}, ']}}') end"""
    rows = _sbom_parts(spark, sf_dir).withColumn("t", F.expr(component)).withColumn("s", F.expr(system))
    # Odd parts lie within the component of an even one.
    files = rows.groupBy("f").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") % 12 < 6, F.col("t")))), ",").alias("top"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") % 12 >= 6, F.col("t")))), ",").alias("deep"), F.max("s").alias("s"))
    text = F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","components":[{"type":"file","name":"holder","components":['), F.col("deep"), F.lit("]}"), F.when(F.col("top") != "", F.concat(F.lit(","), F.col("top"))).otherwise(""), F.col("s"), F.lit("]}"))
    return files.select(F.format_string("/x/%d/bom.json", F.col("f")).alias("path"), text.cast("binary").alias("content"))


@query(
    f"""
{_DOCUMENTS.replace("STRING", "VARCHAR")}
SELECT concat('/x/', f, '/bom.json') AS path, CASE WHEN c = 3 THEN 'npm' WHEN id IS NOT NULL THEN key WHEN c = 2 THEN 'Debian:11' END AS ecosystem, CASE WHEN c = 3 THEN concat('@s/n', k) ELSE concat('n', k) END AS name,
  CASE c WHEN 0 THEN concat('1.', z, '-r0') WHEN 1 THEN concat('2:1.', z, '-1.el9') WHEN 2 THEN concat('1.', z, '-1') ELSE concat('0.', z) END AS version, CASE c WHEN 0 THEN concat('origin', k) WHEN 1 THEN concat('src', k) END AS source_name,
  CASE WHEN c = 1 THEN concat('mod:', z) END AS module_stream, concat('/db/', k) AS location, id AS distro FROM p JOIN s USING (d) WHERE c < 4
"""
)
def sbom_packages(spark, sf_dir):
    """Packages of CycloneDX documents, placed by the distribution that the document names."""
    rows = inventory.resolved(inventory.parse_files(_cyclonedx_files(spark, sf_dir)))
    return rows.filter("name is not null").select("path", "ecosystem", "name", "version", "source_name", "module_stream", "location", "distro")


@query(
    """
WITH p AS (SELECT p_partkey % 60 AS f, CAST(floor(p_partkey / 6) AS BIGINT) % 9 AS c FROM part)
SELECT concat('/x/', f, '/bom.json') AS path, count(*) FILTER (c < 8) AS components, count(*) FILTER (c < 4) AS cataloged, count(*) FILTER (c = 5) AS no_purl, count(*) FILTER (c = 7) AS no_version, count(*) FILTER (c IN (4, 6)) AS unsupported FROM p GROUP BY f HAVING count(*) FILTER (c < 8) > 0
"""
)
def sbom_components(spark, sf_dir):
    """What became of every component of those documents."""
    return inventory.components(inventory.resolved(inventory.parse_files(_cyclonedx_files(spark, sf_dir)))).filter("components > 0")


@query(
    """
WITH p AS (SELECT p_partkey % 60 AS f, p_partkey AS k, p_size AS z, p_partkey % 5 AS c FROM part), r AS (SELECT *, unnest([8, 9]) AS rel FROM p WHERE c = 0)
SELECT concat('/x/', f, '/x.spdx.json') AS path, NULL AS reason, concat('Red Hat:', rel) AS ecosystem, concat('n', k) AS name, concat('1.', z) AS version, concat('mod:', z) AS module_stream FROM r
UNION ALL SELECT concat('/x/', f, '/x.spdx.json'), CASE c WHEN 2 THEN 'a component without a version' WHEN 3 THEN 'a component without a package URL' WHEN 4 THEN 'a source package or a public key' END, CASE WHEN c = 1 THEN 'PyPI' END, CASE WHEN c = 1 THEN concat('n', k) END, CASE WHEN c = 1 THEN concat('1.', z) END, NULL FROM p WHERE c > 0
"""
)
def sbom_spdx(spark, sf_dir):
    """SPDX documents: Red Hat's packages name a URL for each repository, repeated URLs count once, only a URL tells a
    version, the described package is left out."""
    D.views(spark, sf_dir, "part")
    ref = lambda url: f"""'{{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":"', {url}, '"}}'"""
    red = lambda rel: ref(f"concat('pkg:rpm/redhat/n', k, '@1.', z, '?arch=x86_64&repository_id=rhel-{rel}-for-x&rpmmod=mod:', z, ':8030:abc')")
    refs = f"""case c when 0 then concat({red(8)}, ',', {red(9)}, ',', {red(9)}) when 1 then concat({ref("concat('pkg:pypi/n', k, '@1.', z)")}, ',', {ref("concat('pkg:pypi/n', k, '@1.', z, '?x=y')")}) when 2 then concat({ref("concat('pkg:pypi/n', k)")}) when 3 then '' else concat({ref("concat('pkg:rpm/redhat/n', k, '@1?arch=src')")}) end"""
    rows = spark.sql(f"""SELECT f, concat('{{"SPDXID":"SPDXRef-', k, '","name":"n","versionInfo":"9","externalRefs":[', {refs}, ']}}') AS t FROM (SELECT p_partkey % 60 AS f, p_partkey AS k, p_size AS z, p_partkey % 5 AS c FROM part)""")
    root = '{"SPDXID":"SPDXRef-root","externalRefs":[{"referenceType":"purl","referenceLocator":"pkg:npm/root@1"}]}'
    text = F.concat(F.lit(f'{{"spdxVersion":"SPDX-2.3","SPDXID":"SPDXRef-DOCUMENT","packages":[{root},'), F.array_join("t", ","), F.lit('],"relationships":[{"spdxElementId":"SPDXRef-DOCUMENT","relationshipType":"DESCRIBES","relatedSpdxElement":"SPDXRef-root"}]}'))
    files = rows.groupBy("f").agg(F.array_sort(F.collect_list("t")).alias("t")).select(F.format_string("/x/%d/x.spdx.json", F.col("f")).alias("path"), text.cast("binary").alias("content"))
    return inventory.resolved(inventory.parse_files(files)).select("path", "reason", "ecosystem", "name", "version", "module_stream")


def _feed(spark, rows: DataFrame, tag: str) -> str:
    """Writes rows (k, text) as a file each."""
    path = new_path(spark, tag)
    rows.select("k", "text").write.partitionBy("k").text(path)
    return path


def _cve(column: str):
    return F.concat(F.lit("CVE-2024-"), F.col(column).cast("string"))


@query("SELECT concat('CVE-2024-', 10000 + c_custkey) AS cve, 'NVD' AS source, CAST(1 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS vectors FROM customer WHERE c_custkey % 5 > 0")
def read_nvd(spark, sf_dir):
    """Pages of NVD's records; a record without a vector gives no rating."""
    c = D.table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey") + 10_000)
    one = F.when(F.col("c_custkey") % 5 > 0, F.lit('"cvssMetricV31":[{"cvssData":{"vectorString":"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}}]')).otherwise(F.lit('"cvssMetricV31":[]'))
    two = F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_custkey") % 5 > 0), F.lit(',"cvssMetricV2":[{"cvssData":{"vectorString":"AV:N/AC:L/Au:N/C:P/I:P/A:P"}}]')).otherwise("")
    record = F.concat(F.lit('{"cve":{"id":"'), _cve("id"), F.lit('","metrics":{'), one, two, F.lit("}}}"))
    pages = c.groupBy((F.col("c_custkey") % 7).alias("k")).agg(F.collect_list(record).alias("t"))
    text = F.concat(F.lit('{"totalResults":1,"vulnerabilities":['), F.array_join("t", ","), F.lit("]}"))
    return feeds.nvd_ratings(spark, _feed(spark, pages.select("k", text.alias("text")), "nvd")).select("cve", "source", F.size("severity").alias("vectors"))


@query("SELECT concat('CVE-2024-', 10000 + c_custkey) AS cve, CAST((c_custkey % 100) AS DOUBLE) / 100 AS epss, CAST((c_custkey % 50) AS DOUBLE) / 50 AS epss_percentile, 'v2024.01.01' AS epss_model FROM customer")
def read_epss(spark, sf_dir):
    """EPSS lists: a comment that names the model, a head, and a line per CVE."""
    c = D.table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey") + 10_000)
    line = F.concat_ws(",", _cve("id"), ((F.col("c_custkey") % 100).cast("double") / 100).cast("string"), ((F.col("c_custkey") % 50).cast("double") / 50).cast("string"))
    lines = c.groupBy((F.col("c_custkey") % 8).alias("k")).agg(F.array_sort(F.collect_list(line)).alias("t"))
    text = F.concat(F.lit("#model_version:v2024.01.01,score_date:2024-01-02\ncve,epss,percentile\n"), F.array_join("t", "\n"))
    return feeds.epss_ratings(spark, _feed(spark, lines.select("k", text.alias("text")), "epss")).select("cve", "epss", "epss_percentile", "epss_model")


@query("SELECT concat('CVE-2024-', 10000 + s_suppkey) AS cve, true AS kev, CASE WHEN s_suppkey % 4 > 0 THEN '2024-01-02' END AS added, s_suppkey % 2 = 0 AS ransomware FROM supplier")
def read_kev(spark, sf_dir):
    """Catalogues of exploited vulnerabilities, whose declared counts hold; a date that is none is null."""
    s = D.table(spark, sf_dir, "supplier").withColumn("id", F.col("s_suppkey") + 10_000)
    one = F.concat(F.lit('{"cveID":"'), _cve("id"), F.lit('","dateAdded":"'), F.when(F.col("s_suppkey") % 4 > 0, "2024-01-02").otherwise("soon"), F.lit('","knownRansomwareCampaignUse":"'), F.when(F.col("s_suppkey") % 2 == 0, "Known").otherwise("Unknown"), F.lit('"}'))
    whole = s.groupBy((F.col("s_suppkey") % 8).alias("k")).agg(F.collect_list(one).alias("t"))
    text = F.concat(F.lit('{"count":'), F.size("t").cast("string"), F.lit(',"vulnerabilities":['), F.array_join("t", ","), F.lit("]}"))
    out = feeds.kev_ratings(spark, _feed(spark, whole.select("k", text.alias("text")), "kev"))
    return out.select("cve", "kev", F.col("kev_date_added").cast("string").alias("added"), F.col("kev_ransomware").alias("ransomware"))


@query(
    """
SELECT concat('GHSA-', p_partkey) AS advisory_id, CASE p_partkey % 4 WHEN 0 THEN 'Packagist' WHEN 1 THEN 'npm' WHEN 2 THEN 'Alpine:v3.19' ELSE 'Debian:12' END AS ecosystem, concat('pkg-', p_partkey % 50) AS name,
  CASE p_partkey % 4 WHEN 2 THEN concat(p_size, '.1-r2') ELSE concat(p_size, '.1.0') END AS fixed FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 7 <> 3
"""
)
def read_osv(spark, sf_dir):
    """OSV records: withdrawn ones and lineage keys go, a mirror folds into its ecosystem, an Alpine bound is repaired."""
    k = F.col("p_partkey")
    eco = F.get(F.array(*map(F.lit, ["Packagist:https://mirror", "npm", "Alpine:v3.19", "Debian:12"])), (k % 4).cast("int"))
    fixed = F.concat(F.col("p_size").cast("string"), F.when(k % 4 == 2, ".1.r2").otherwise(".1.0"))
    entry = lambda e: F.concat(F.lit('{"package":{"name":"pkg-'), (k % 50).cast("string"), F.lit('","ecosystem":"'), e, F.lit('"},"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"'), fixed, F.lit('"}]},{"type":"GIT","events":[{"introduced":"0"}]}]}'))
    withdrawn = F.when(k % 6 == 0, ',"withdrawn":"2024-01-01T00:00:00Z"').otherwise("")
    id_of = F.concat(F.when(k % 7 == 3, "MAL-").otherwise("GHSA-"), k.cast("string"))
    record = F.concat(F.lit('{"id":"'), id_of, F.lit('","modified":"2024-01-01T00:00:00Z"'), withdrawn, F.lit(',"affected":['), entry(eco), F.lit(","), entry(F.lit("Ubuntu:Pro:22.04:LTS")), F.lit("]}"))
    files = D.table(spark, sf_dir, "part").groupBy((k % 16).alias("k")).agg(F.collect_list(record).alias("t"))
    path = _feed(spark, files.select("k", F.concat(F.lit("["), F.array_join("t", ","), F.lit("]")).alias("text")), "osv")
    e = feeds.osv_affected(feeds.osv_records(spark, path))
    return e.select("advisory_id", "ecosystem", "name", F.get(F.filter(F.transform(F.get("ranges", F.lit(0))["events"], lambda x: x["fixed"]), lambda x: x.isNotNull()), F.lit(0)).alias("fixed"))


@query(
    """
SELECT concat('ALAS-', s_suppkey) AS advisory_id, concat('lib-', s_suppkey % 9) AS name, CASE WHEN s_suppkey % 3 = 0 THEN '2:1.0-3' ELSE '1.0-3' END AS fixed, concat('CVE-2024-', s_suppkey) AS cve,
  ['Critical', 'Important', 'Medium', 'Low'][1 + s_suppkey % 4] AS word FROM supplier WHERE s_suppkey % 5 > 0
"""
)
def read_updateinfo(spark, sf_dir):
    """updateinfo XML: security updates only; of a package's builds the first."""
    s, k = D.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    word = F.get(F.array(*map(F.lit, ["critical", "important", "medium", "low"])), (k % 4).cast("int"))
    build = lambda v: F.concat(F.lit('<package name="lib-'), (k % 9).cast("string"), F.lit('" epoch="'), F.when(k % 3 == 0, "2").otherwise("0"), F.lit(f'" version="{v}" release="3" arch="x86_64"/>'))
    update = F.concat(F.lit('<update type="'), F.when(k % 5 > 0, "security").otherwise("bugfix"), F.lit('"><id>ALAS-'), k.cast("string"), F.lit("</id><severity>"), word, F.lit('</severity><references><reference id="CVE-2024-'), k.cast("string"), F.lit('" type="cve"/></references><pkglist><collection>'), build("1.0"), build("1.1"), F.lit("</collection></pkglist></update>"))
    files = s.groupBy((k % 4).alias("k")).agg(F.collect_list(update).alias("t"))
    path = _feed(spark, files.select("k", F.concat(F.lit("<updates>"), F.array_join("t", ""), F.lit("</updates>")).alias("text")), "updateinfo")
    e = feeds.updateinfo_affected(spark, path, "Amazon Linux:2")
    return e.select("advisory_id", "name", F.get(F.filter(F.transform(F.get("ranges", F.lit(0))["events"], lambda x: x["fixed"]), lambda x: x.isNotNull()), F.lit(0)).alias("fixed"), F.get("cves", F.lit(0)).alias("cve"), "word")


@query(
    """
WITH r AS (SELECT CASE WHEN p_partkey % 6 = 0 THEN 'withdrawn' WHEN p_partkey % 7 = 3 THEN 'malware' END AS w, p_partkey FROM part), k AS (SELECT * FROM r WHERE w IS NULL)
SELECT 'records' AS step, w AS reason, count(*) AS n FROM r WHERE w IS NOT NULL GROUP BY w UNION ALL SELECT 'entries', 'no name', count(*) FROM k WHERE p_partkey % 5 = 0 UNION ALL SELECT 'entries', 'no range and no version', count(*) FROM k WHERE p_partkey % 5 = 1
"""
)
def feed_drops(spark, sf_dir):
    """What an OSV feed leaves out, counted by reason in the pass that leaves it out."""
    from patchweave.operators import telemetry

    k = F.col("p_partkey")
    record = F.concat(
        F.lit('{"id":"'), F.when(k % 7 == 3, "MAL-").otherwise("GHSA-"), k.cast("string"), F.lit('"'), F.when(k % 6 == 0, ',"withdrawn":"2024-01-01T00:00:00Z"').otherwise(""), F.lit(',"affected":[{"package":{"ecosystem":"npm","name":"'), F.when(k % 5 == 0, "").otherwise("a"), F.lit('"}'),
        F.when(k % 5 == 1, ',"ranges":[{"type":"GIT","events":[{"introduced":"0"}]}]').otherwise(',"versions":["1.0.0"]'), F.lit("}]}"),
    )
    drops = telemetry.Drops("OSV")
    raw = D.table(spark, sf_dir, "part").select(F.from_json(record, feeds._OSV).alias("r")).select("r.*")
    feeds.osv_affected(feeds.counted_records(raw, drops), drops).write.format("noop").mode("overwrite").save()
    return telemetry.dropped(telemetry.provenance(spark, drops)).select("step", "reason", "n")
