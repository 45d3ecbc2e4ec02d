"""Registered queries of feeds, images and lifecycles over documents that are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchweave.functions import cvss4
from patchweave.functions import names as N
from patchweave.operators import layers as L
from patchweave.operators import lifecycle as T
from patchweave.operators import store as K
from patchweave.plans import derive as D
from patchweave.plans.registry import query
from patchweave.sources import csaf, inventory, oval
from patchweave.sources import distributions as U
from patchweave.sources import images as G
from patchweave.tables import new_path

# ---- CSAF ----


def _redhat(spark, sf_dir):
    """A document per part: a main platform, an extended one, a fixed build, and a package without a fix."""
    D.views(spark, sf_dir, "part")
    return spark.sql("""
SELECT concat('d', p_partkey) AS doc, concat('{"document":{"tracking":{"id":"RHSA-1"},"title":"t"},"product_tree":{"branches":[{"category":"vendor","branches":[
 {"category":"product_family","branches":[{"category":"product_name","product":{"product_id":"RHEL","product_identification_helper":{"cpe":"cpe:/o:redhat:enterprise_linux:', p_partkey % 3 + 7, '.2::baseos"}}}]},
 {"category":"product_name","product":{"product_id":"EUS","product_identification_helper":{"cpe":"cpe:/o:redhat:rhel_eus:9.2"}}}]}]},
 "vulnerabilities":[{"cve":"CVE-2024-', p_partkey + 100000, '","product_status":{"fixed":["RHEL:bash-0:5.', p_size, '-1.el9.x86_64","RHEL:bash-0:5.', p_size, '-1.el9.src","EUS:bash-0:4-1.el9.x86_64","RHEL:mod-0:1.module+el8-1.noarch", "RHEL:perl-0:5.1.module+el8.x86_64::perl:5.30"],
 "known_affected":[', case when p_partkey % 3 = 0 then '"RHEL:zlib","RHEL:img@sha256:0"' else '"RHEL"' end, ']},
 "remediations":[{"category":"', case when p_partkey % 2 = 0 then 'no_fix_planned' else 'none_available' end, '","product_ids":["RHEL:zlib"]}],
 "scores":[{"cvss_v3":{"vectorString":"CVSS:3.1/AV:N"}}]}]}') AS text FROM part""")


@query(
    """
WITH p AS (SELECT p_partkey, concat('CVE-2024-', p_partkey + 100000) AS cve, concat('Red Hat:', p_partkey % 3 + 7) AS ecosystem, p_size FROM part)
SELECT cve, ecosystem, 'bash' AS name, NULL AS module_stream, concat('0:5.', p_size, '-1.el9') AS fixed, NULL AS fix_state FROM p
UNION ALL SELECT cve, ecosystem, 'perl', 'perl:5.30', '0:5.1.module+el8', NULL FROM p
UNION ALL SELECT cve, ecosystem, 'zlib', NULL, '', CASE WHEN p_partkey % 2 = 0 THEN 'wont-fix' ELSE 'not-fixed' END FROM p WHERE p_partkey % 3 = 0
"""
)
def evr_sets(spark, sf_dir):
    sets = csaf.evr_sets(csaf.mentions(_redhat(spark, sf_dir), "REDHAT"))
    return sets.select("cve", "ecosystem", "name", "module_stream", F.array_join("fixed", ",").alias("fixed"), "fix_state")


@query("SELECT 'other platform' AS why, count(*) AS n FROM part UNION ALL SELECT 'module build', count(*) FROM part UNION ALL SELECT 'image', count(*) FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'whole product', count(*) FROM part WHERE p_partkey % 3 > 0")
def csaf_skipped(spark, sf_dir):
    return csaf.skipped(csaf.mentions(_redhat(spark, sf_dir), "REDHAT"))


@query(
    """
WITH p AS (SELECT concat('CVE-2024-', s_suppkey + 100000) AS advisory_id, s_suppkey AS k, ['SLES:15.SP5', 'openSUSE Leap:15.6', 'SLES:16.0', 'SLES:12'][CAST(1 + s_suppkey % 4 AS INT)] AS ecosystem FROM supplier)
SELECT 'SUSE' AS database, advisory_id, 0 AS aff_ord, ecosystem, 'zypper' AS name, concat('0..1.', k, '-1 ') AS ranges FROM p
UNION ALL SELECT 'SUSE', advisory_id, 1, ecosystem, 'zz', '0..unknown' FROM p WHERE k % 2 = 0
"""
)
def csaf_affected(spark, sf_dir):
    D.views(spark, sf_dir, "supplier")
    docs = spark.sql("""
WITH s AS (SELECT s_suppkey AS k, case s_suppkey % 4 when 0 then 'SUSE Linux Enterprise Server 15 SP5' when 1 then 'openSUSE Leap 15.6' when 2 then 'SUSE Linux Enterprise Server 16.0' else 'SUSE Linux Enterprise Module for Basesystem 12' end AS plat FROM supplier)
SELECT concat('d', k) AS doc, concat('{"document":{"tracking":{"id":"CVE-2024-', k + 100000, '"}},"product_tree":{"branches":[{"category":"vendor","branches":[
 {"category":"product_name","product":{"product_id":"', plat, '"}},{"category":"product_name","product":{"product_id":"openSUSE Tumbleweed"}},
 {"category":"product_version","product":{"product_id":"zypper-1","product_identification_helper":{"purl":"pkg:rpm/suse/zypper@1.', k, '-1?arch=x"}}},
 {"category":"product_version","product":{"product_id":"zz","product_identification_helper":{"purl":"pkg:rpm/suse/zz@?arch=x"}}}]}]},
 "vulnerabilities":[{"product_status":{"recommended":["', plat, ':zypper-1","openSUSE Tumbleweed:zypper-1","', plat, ':none"],"known_affected":[', case when k % 2 = 0 then concat('"', plat, ':zz"') else '' end, ']}}]}') AS text FROM s""")
    a = csaf.affected(docs, "SUSE")
    text = F.array_join(F.transform("ranges", lambda r: F.concat(F.lit("0.."), F.coalesce(F.concat(F.get(r["events"], F.lit(1))["fixed"], F.lit(" ")), F.lit("")), F.coalesce(r["fix_state"], F.lit("")))), ",")
    return a.select("database", "advisory_id", "aff_ord", "ecosystem", "name", text.alias("ranges"))


# ---- OVAL, Bodhi, Ubuntu ----


@query(
    """
WITH d AS (SELECT o_orderkey AS k, o_custkey % 400 AS c FROM orders),
f AS (SELECT k, c, 8 AS major, concat('p', c % 9) AS name, '' AS stream, concat('1.', CASE WHEN c % 5 = 0 THEN k % 2 ELSE c END, '-1.el8') AS evr FROM d
  UNION ALL SELECT k, c, 8, 'gated', 'perl:5.30', concat('2-', c) FROM d UNION ALL SELECT k, c, 9, 'nine', '', '3-1' FROM d WHERE k % 3 = 0),
bad AS (SELECT c, major, name, stream FROM f GROUP BY ALL HAVING count(DISTINCT evr) > 1)
SELECT concat('ELSA-', k) AS advisory_id, concat('Oracle Linux:', major) AS ecosystem, name, nullif(stream, '') AS module_stream, evr AS fixed FROM f WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.c = f.c AND b.major = f.major AND b.name = f.name AND b.stream = f.stream)
"""
)
def oval_affected(spark, sf_dir):
    """A tree per order: a release at the root, a package and a module's gate below it, a deeper release of its own."""
    D.views(spark, sf_dir, "orders")
    defs = spark.sql("SELECT concat('def:', o_orderkey) AS def_id, concat('ELSA-', o_orderkey) AS advisory_id, array(concat('CVE-2024-', o_custkey % 400)) AS cves FROM orders")
    node = lambda path, pos, test, comment, where="": f"SELECT concat('def:', o_orderkey) AS def_id, cast(array({path}) as array<int>) AS path, {pos} AS pos, {test} AS test_ref, {comment} AS comment FROM orders {where}"
    own = "concat('1.', case when o_custkey % 400 % 5 = 0 then o_orderkey % 2 else o_custkey % 400 end, '-1.el8')"
    key = "concat('p', o_custkey % 400 % 9)"
    found = spark.sql(" UNION ALL ".join([
        node("", 0, "'rel8'", "''"), node("0", 0, f"concat({key}, {own})", "''"), node("0", 1, "concat('ks', o_orderkey)", "''"),
        node("1", 0, "'gate'", "'Module perl:5.30 is enabled'"), node("1, 0", 0, "concat('gated', o_custkey % 400)", "''"),
        node("2", 0, "'rel9'", "''", "WHERE o_orderkey % 3 = 0"), node("2, 0", 0, "'nine'", "''", "WHERE o_orderkey % 3 = 0"),
    ]))
    null = "cast(null as string)"
    tested = spark.sql(f"""
SELECT DISTINCT concat({key}, {own}) AS test_ref, {key} AS package, {own} AS evr, cast(null as int) AS major, {null} AS module, false AS gate FROM orders
UNION ALL SELECT DISTINCT concat('gated', o_custkey % 400), 'gated', concat('2-', o_custkey % 400), null, null, false FROM orders
UNION ALL SELECT concat('ks', o_orderkey), 'kernel', concat(o_orderkey, '.ksplice1.el8'), null, null, false FROM orders
UNION ALL SELECT * FROM VALUES ('rel8', {null}, {null}, 8, {null}, false), ('rel9', {null}, {null}, 9, {null}, false), ('gate', {null}, {null}, cast(null as int), {null}, true), ('nine', 'nine', '3-1', cast(null as int), {null}, false)""")
    a = oval.affected(defs, oval.fixes(found, tested))
    return a.select("advisory_id", "ecosystem", "name", "module_stream", F.get(F.get("ranges", F.lit(0))["events"], F.lit(1))["fixed"].alias("fixed"))


@query(
    """
SELECT 'FEDORA' AS database, concat('FEDORA-', c_custkey) AS advisory_id, concat('Fedora:', 38 + c_nationkey % 4) AS ecosystem, concat('pkg-', c_nationkey, '-libs') AS name, concat(CASE WHEN c_custkey % 3 > 0 THEN concat(c_custkey % 3, ':') ELSE '' END, c_custkey, '.0-2.fc40') AS fixed,
  concat('CVE-2024-', c_custkey + 10000) AS cves, CASE WHEN c_custkey % 4 < 3 THEN ['Urgent','High','Low'][1 + c_custkey % 4] END AS word FROM customer WHERE c_custkey % 5 > 1
"""
)
def bodhi_affected(spark, sf_dir):
    D.views(spark, sf_dir, "customer")
    updates = spark.sql("""
SELECT concat('FEDORA-', c_custkey) AS alias, concat('fix CVE-2024-', c_custkey + 10000) AS title, concat('CVE-2024-', c_custkey + 10000, ' again, cve-2024-1') AS notes, case c_custkey % 4 when 0 then 'urgent' when 1 then 'high' when 2 then ' LOW' else 'unspecified' end AS severity,
  case when c_custkey % 5 = 1 then 'bugfix' else 'security' end AS type, named_struct('name', 'F', 'id_prefix', case when c_custkey % 5 = 0 then 'FEDORA-EPEL' else 'FEDORA' end, 'version', cast(38 + c_nationkey % 4 as string)) AS release,
  array(named_struct('nvr', 'bad', 'epoch', 0, 'type', 'rpm'), named_struct('nvr', 'm-1-1', 'epoch', 0, 'type', 'module'), named_struct('nvr', concat('pkg-', c_nationkey, '-libs-', c_custkey, '.0-2.fc40'), 'epoch', cast(c_custkey % 3 as int), 'type', 'rpm'), named_struct('nvr', concat('pkg-', c_nationkey, '-libs-9-9'), 'epoch', 0, 'type', 'rpm')) AS builds FROM customer""")
    a = U.bodhi_affected(updates)
    return a.select("database", "advisory_id", "ecosystem", "name", F.get(F.get("ranges", F.lit(0))["events"], F.lit(1))["fixed"].alias("fixed"), F.array_join("cves", ",").alias("cves"), "word")


@query(
    """
WITH s AS (SELECT s_suppkey % 100 AS c, s_suppkey % 3 AS r, s_suppkey % 2 AS w FROM supplier)
SELECT concat('USN-', p_partkey) AS advisory_id, CASE WHEN p_size % 2 = 1 THEN CASE w WHEN 0 THEN 'wont-fix' WHEN 1 THEN 'not-fixed' END END AS fix_state
FROM part LEFT JOIN (SELECT c, r, min(w) AS w FROM s GROUP BY ALL) ON c = p_partkey % 120 AND r = p_partkey % 3
"""
)
def ubuntu_fix_state(spark, sf_dir):
    D.views(spark, sf_dir, "supplier", "part")
    files = spark.sql("""
SELECT concat('active/', lpad(c, 3, '0'), '-', r, '-', case when w = 1 then 'a' else 'b' end) AS path, concat('Candidate: CVE-2024-', 1000 + c, '\\nPublicDate: x\\nupstream_bash: released (1)\\n', case r when 0 then 'focal' when 1 then 'jammy' else 'noble' end, '_bash: ', case w when 0 then 'ignored (end of life)' else 'needed' end, '\\nwarty_bash: needed\\n') AS value
FROM (SELECT DISTINCT s_suppkey % 100 AS c, s_suppkey % 3 AS r, s_suppkey % 2 AS w FROM supplier)""")
    event = "named_struct('introduced', '0', 'fixed', {}, 'last_affected', cast(null as string), 'limit', cast(null as string))"
    affected = spark.sql(f"""
SELECT concat('USN-', p_partkey) AS advisory_id, concat('Ubuntu:', case p_partkey % 3 when 0 then '20.04' when 1 then '22.04' else '24.04' end, ':LTS') AS ecosystem, 'bash' AS name,
  array(named_struct('type', 'ECOSYSTEM', 'events', array({event.format("case when p_size % 2 = 0 then '1' end")}), 'fix_state', cast(null as string))) AS ranges FROM part""")
    upstream = spark.sql("SELECT concat('USN-', p_partkey) AS advisory_id, array('x', concat('CVE-2024-', 1000 + p_partkey % 120)) AS upstream FROM part")
    stamped = U.stamp_ubuntu(affected, upstream, U.ubuntu_states(files))
    return stamped.select("advisory_id", F.get("ranges", F.lit(0))["fix_state"].alias("fix_state"))


# ---- CVSS v4 ----

_V4 = "SELECT p_partkey, ['N','A','L','P'][1 + p_partkey % 4] AS av, ['L','H'][1 + p_partkey // 4 % 2] AS ac, ['N','P'][1 + p_size % 2] AS att, ['N','L','H'][1 + p_size % 3] AS pr, ['N','P','A'][1 + p_partkey % 3] AS ui, ['H','L','N'][1 + p_partkey // 3 % 3] AS vc, ['H','L','N'][1 + p_size // 2 % 3] AS sc, ['A','P','U'][1 + p_partkey // 2 % 3] AS e FROM part"


@query(
    f"""
WITH v AS ({_V4}), l AS (SELECT *, CAST(strpos('NALP', av) - 1 AS INT) AS lav, CAST(strpos('NLH', pr) - 1 AS INT) AS lpr, CAST(strpos('NPA', ui) - 1 AS INT) AS lui, CAST(ac = 'H' AS INT) AS lac, CAST(att = 'P' AS INT) AS lat FROM v),
q AS (SELECT *, CASE WHEN lav + lpr + lui = 0 THEN 0 WHEN (lav = 0 OR lpr = 0 OR lui = 0) AND av <> 'P' THEN 1 ELSE 2 END AS e1, CASE WHEN lac + lat = 0 THEN 0 ELSE 1 END AS e2, CASE vc WHEN 'H' THEN 0 ELSE 2 END AS e3, CASE vc WHEN 'H' THEN 0 ELSE 1 END AS e6, CASE sc WHEN 'H' THEN 1 ELSE 2 END AS e4, CAST(strpos('APU', e) - 1 AS INT) AS e5 FROM l),
d AS (SELECT *, 10.0::DOUBLE - 0.917 * e1 - 0.531 * e2 - 0.713 * e3 - 0.619 * e4 - 0.407 * e5 - 0.293 * e6 AS s,
  CASE e1 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN lav >= 1 THEN (lav - 1 + lpr + lui) / 4 WHEN lpr >= 1 THEN (lav + lpr - 1 + lui) / 4 ELSE (lav + lpr + lui - 1) / 4 END ELSE CASE WHEN lav >= 3 THEN (lav - 3 + lpr + lui) / 5 ELSE (lav - 1 + lpr - 1 + lui - 1) / 5 END END AS d1,
  CASE e2 WHEN 0 THEN (lac + lat) / 1 ELSE (lac + lat - 1) / 2 END AS d2, CASE vc WHEN 'H' THEN 0 WHEN 'L' THEN 0 ELSE 3.0 / 10 END AS d36, CASE sc WHEN 'H' THEN 0 WHEN 'L' THEN 0 ELSE 3.0 / 4 END AS d4 FROM q),
n AS (SELECT *, CAST(e1 < 2 AS INT) + CAST(e2 < 1 AS INT) + CAST(e3 = 0 AS INT) + CAST(e4 < 2 AS INT) + CAST(e5 < 2 AS INT) AS lower,
  CASE WHEN e1 < 2 THEN 0.917 * d1 ELSE 0 END + CASE WHEN e2 < 1 THEN 0.531 * d2 ELSE 0 END + CASE WHEN e3 = 0 THEN 0.293 * d36 ELSE 0 END + CASE WHEN e4 < 2 THEN 0.619 * d4 ELSE 0 END AS off FROM d)
SELECT p_partkey, CASE WHEN vc = 'N' AND sc = 'N' THEN 0 ELSE CAST(floor(greatest(0, least(10, s - CASE WHEN lower > 0 THEN off / lower ELSE 0 END)) * 10 + 0.5) AS INT) END AS tenths FROM n
"""
)
def cvss4_score(spark, sf_dir):
    """The table is the specification's and no part of this repository: here it is a rule, one step down per class."""
    steps, levels = (0.917, 0.531, 0.713, 0.619, 0.407, 0.293), (3, 2, 3, 3, 3, 2)
    table: dict[str, float] = {"": 10.0}
    for step, n in zip(steps, levels, strict=True):
        table = {k + str(i): s - step * i for k, s in table.items() for i in range(n)}
    table = {k: s for k, s in table.items() if k[2] + k[5] != "20"}
    D.views(spark, sf_dir, "part")
    pick = lambda letters, i: f"substring('{letters}', cast(1 + {i} as int), 1)"
    c, s = pick("HLN", "floor(p_partkey / 3) % 3"), pick("HLN", "floor(p_size / 2) % 3")
    parts = [("AV", pick("NALP", "p_partkey % 4")), ("AC", pick("LH", "floor(p_partkey / 4) % 2")), ("AT", pick("NP", "p_size % 2")), ("PR", pick("NLH", "p_size % 3")), ("UI", pick("NPA", "p_partkey % 3")), ("VC", c), ("VI", c), ("VA", c), ("SC", s), ("SI", s), ("SA", s), ("E", pick("APU", "floor(p_partkey / 2) % 3"))]
    v = spark.sql("SELECT p_partkey, concat('CVSS:4.0', " + ", ".join(f"'/{k}:', {x}" for k, x in parts) + ") AS vector FROM part")
    scored = cvss4.with_score(v.select("vector").distinct(), "vector", table)
    return v.join(scored, "vector").select("p_partkey", F.round(F.col("score") * 10).cast("int").alias("tenths"))


# ---- images and inventories ----


@query(
    """
WITH e AS (SELECT CAST(l_orderkey % 200 AS BIGINT) AS image_id, CAST(l_linenumber AS INT) AS layer, concat('d', l_partkey % 3, '/f', l_suppkey % 5) AS path, min(l_quantity) AS q FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY ALL),
w AS (SELECT DISTINCT CAST(l_orderkey % 200 AS BIGINT) AS image_id, CAST(l_linenumber AS INT) AS layer, CASE WHEN l_partkey % 11 = 0 THEN concat('d', l_partkey % 3) ELSE concat('d', l_partkey % 3, '/f', l_partkey % 5) END AS hides, l_partkey % 11 = 0 AS opaque FROM lineitem WHERE l_suppkey % 7 = 0 AND l_orderkey % 4 = 0),
n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY image_id, path ORDER BY layer DESC) = 1)
SELECT image_id, layer, path, q FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.image_id = n.image_id AND w.layer > n.layer AND (w.hides = n.path OR starts_with(n.path, concat(w.hides, '/'))))
"""
)
def image_files(spark, sf_dir):
    D.views(spark, sf_dir, "lineitem")
    entries = spark.sql("""
SELECT l_orderkey % 200 AS image_id, cast(l_linenumber as int) AS layer, concat('d', l_partkey % 3, '/f', l_suppkey % 5) AS path, 'file' AS kind, min(l_quantity) AS q FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY ALL
UNION ALL SELECT DISTINCT l_orderkey % 200, cast(l_linenumber as int), case when l_partkey % 11 = 0 then concat('d', l_partkey % 3, '/.wh..wh..opq') else concat('d', l_partkey % 3, '/.wh.f', l_partkey % 5) end, 'file', cast(null as double) FROM lineitem WHERE l_suppkey % 7 = 0 AND l_orderkey % 4 = 0""")
    return L.visible(entries).select("image_id", "layer", "path", "q")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Ubuntu:22.04:LTS' ELSE 'Ubuntu:22.04' END WHEN 1 THEN concat('Alpine:v3.', c_nationkey) END AS ecosystem FROM customer")
def os_release(spark, sf_dir):
    D.views(spark, sf_dir, "customer")
    t = spark.sql("""SELECT c_custkey, case c_custkey % 3 when 0 then concat('NAME=x\\nID=ubuntu\\nVERSION_ID="22.04"\\nPRETTY_NAME="Ubuntu', case when c_nationkey % 2 = 0 then ' LTS"' else '"' end) when 1 then concat("ID='alpine'\\nVERSION_ID=3.", c_nationkey, '.5\\n') else 'VERSION_ID=1' end AS content FROM customer""")
    return t.select("c_custkey", G.os_ecosystem()["ecosystem"].alias("ecosystem"))


@query(
    """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Debian:12' WHEN 1 THEN 'Red Hat:9' WHEN 2 THEN 'Alpine:v3.19' END AS ecosystem, CASE s_suppkey % 4 WHEN 3 THEN concat('v', s_suppkey) WHEN 0 THEN concat('2:', s_suppkey, '-1') WHEN 1 THEN concat(s_suppkey, '-1') ELSE concat(s_suppkey, '-r0') END AS version,
  CASE s_suppkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'srpm' END AS source_name, CASE WHEN s_suppkey % 4 = 1 THEN 'perl:5.30' END AS module_stream FROM supplier
"""
)
def distro_purl(spark, sf_dir):
    D.views(spark, sf_dir, "supplier")
    p = spark.sql("""
SELECT s_suppkey, case s_suppkey % 4 when 0 then concat('pkg:deb/debian/n@', s_suppkey, '-1?arch=a&distro=debian-12&epoch=2&upstream=src%401') when 1 then concat('pkg:rpm/redhat/n@', s_suppkey, '-1?arch=x86_64&repository_id=rhel-9-for-x&upstream=srpm-1-1.src.rpm&rpmmod=perl:5.30:8030:abc')
  when 2 then concat('pkg:apk/alpine/n@', s_suppkey, '-r0?distro=alpine-3.19.1&epoch=7') else 'pkg:deb/x/n?distro=plan9-1' end AS purl, concat('v', s_suppkey) AS v FROM supplier""")
    d = N.distro_purl(N.parse_purl(F.col("purl")), F.col("v"), F.lit(None).cast("string"), F.lit(False))
    return p.select("s_suppkey", d.alias("d")).select("s_suppkey", "d.ecosystem", "d.version", "d.source_name", "d.module_stream")


@query("SELECT concat('f', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '/yarn.lock' ELSE '/requirements.txt' END) AS path, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS packages, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE CAST(c_custkey % 2 AS INT) END AS notes, c_custkey % 4 = 0 AS failed FROM customer")
def manifest_status(spark, sf_dir):
    D.views(spark, sf_dir, "customer")
    files = spark.sql("SELECT concat('f', c_custkey, case when c_custkey % 4 = 0 then '/yarn.lock' else '/requirements.txt' end) AS path, cast(case when c_custkey % 4 = 0 then '__metadata:\\n' else concat('a==1.', c_custkey, case when c_custkey % 2 = 1 then '\\nb>=2\\n' else '' end) end as binary) AS content FROM customer")
    return inventory.manifests(inventory.parse_files(files)).select("path", F.col("packages").cast("int").alias("packages"), F.col("notes").cast("int").alias("notes"), "failed")


# ---- lifecycles and the store ----


@query(
    """
WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 30) END AS since, c_custkey % 5 > 0 AS since_known, CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2024-01-10' + INTERVAL 1 DAY * (c_custkey % 30) END AS until FROM customer),
s AS (SELECT c_custkey AS k, TIMESTAMP '2024-01-15' AS s_since, c_custkey % 11 > 0 AS s_known, TIMESTAMP '2024-02-15' AS s_until FROM customer WHERE c_custkey % 7 > 0),
j AS (SELECT *, CASE WHEN s_known IS NULL THEN 'run' WHEN NOT s_known THEN 'unrecorded' WHEN NOT since_known THEN 'run' WHEN since IS NOT NULL AND s_since < since THEN 'seed' WHEN coalesce(since, TIMESTAMP '0001-01-01') < s_since THEN CASE WHEN until IS NULL OR until >= s_since THEN 'joined' ELSE 'gap' END ELSE 'run' END AS w FROM f LEFT JOIN s USING (k))
SELECT concat('S', k) AS source, CAST(CAST(CASE WHEN w IN ('seed', 'gap') THEN s_since WHEN w <> 'unrecorded' THEN since END AS DATE) AS VARCHAR) AS since, CASE WHEN w = 'unrecorded' THEN false ELSE since_known END AS since_known, CAST(CAST(CASE WHEN w IN ('joined', 'gap') THEN s_until ELSE until END AS DATE) AS VARCHAR) AS until, w = 'gap' AS gap FROM j
"""
)
def window_merge(spark, sf_dir):
    D.views(spark, sf_dir, "customer")
    day = lambda start: f"cast(date_add(date'{start}', cast(c_custkey % 30 as int)) as timestamp)"
    fetched = spark.sql(f"SELECT concat('S', c_custkey) AS source, case when c_custkey % 4 > 0 then {day('2024-01-01')} end AS since, c_custkey % 5 > 0 AS since_known, case when c_custkey % 3 > 0 then {day('2024-01-10')} end AS until FROM customer")
    seeded = spark.sql("SELECT concat('S', c_custkey) AS source, timestamp'2024-01-15' AS since, c_custkey % 11 > 0 AS since_known, timestamp'2024-02-15' AS until FROM customer WHERE c_custkey % 7 > 0")
    m = T.merge_windows(seeded, fetched)
    return m.select("source", F.col("since").cast("date").cast("string").alias("since"), "since_known", F.col("until").cast("date").cast("string").alias("until"), "gap")


@query("SELECT event_type AS feed, bool_and(coalesce(nxt <= ts, true)) AS ordered FROM (SELECT event_type, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY event_id DESC) AS nxt FROM events) GROUP BY 1")
def change_feed_order(spark, sf_dir):
    """Feeds that list their changes newest first, as told by their positions."""
    from pyspark.sql import Window

    e = D.table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))
    return T.falls_in_time(e.select(F.col("event_type").alias("feed"), pos.alias("pos"), F.col("ts").alias("changed")))


@query("SELECT o_orderpriority AS run, o_orderstatus AS stage, sum(o_shippriority) AS seconds, CAST(sum(o_shippriority) AS DOUBLE) / (SELECT sum(x.o_shippriority) FROM o x WHERE x.o_orderpriority = o.o_orderpriority) AS share FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey % 100 + 1 AS o_shippriority FROM orders) o GROUP BY 1, 2".replace("FROM o x", "FROM (SELECT o_orderpriority, o_orderkey % 100 + 1 AS o_shippriority FROM orders) x").replace("sum(o_shippriority) AS seconds", "CAST(sum(o_shippriority) AS BIGINT) AS seconds"))
def stage_shares(spark, sf_dir):
    s = D.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("stage"), (F.col("o_orderkey") % 100 + 1).alias("seconds"))
    return T.stage_shares(s)


@query("SELECT concat('GHSA-', p_partkey) AS advisory_id, concat('pkg-', p_partkey % 50) AS name FROM part WHERE p_partkey % 50 = 7 AND p_partkey % 3 = 0")
def store_lookup(spark, sf_dir):
    """Entries written to a store, closed as a build, and read by package."""
    D.views(spark, sf_dir, "part")
    path = new_path(spark, "store")
    K.write_affected(spark.sql("SELECT 'GHSA' AS database, concat('GHSA-', p_partkey) AS advisory_id, 0 AS aff_ord, case p_partkey % 3 when 0 then 'npm' else 'Debian:12' end AS ecosystem, concat('pkg-', p_partkey % 50) AS name FROM part"), path)
    K.write_ratings(D.table(spark, sf_dir, "customer").select(F.concat(F.lit("CVE-"), F.col("c_custkey").cast("string")).alias("cve"), F.lit("NVD").alias("source"), F.lit(1).alias("load_seq")), path)
    K.write_meta(spark, path, "2024-01-01")
    return K.lookup(K.open_store(spark, path)["affected"], "npm", "pkg-7").select("advisory_id", "name")
