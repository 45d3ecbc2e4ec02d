"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.functions import names as N
from patchweave.functions import severity as S
from patchweave.functions import versions as V
from patchweave.operators import findings as X
from patchweave.operators import incremental as C
from patchweave.operators import lifecycle as T
from patchweave.operators import matching as M
from patchweave.operators import ranges as R
from patchweave.operators import reporting as P
from patchweave.plans import derive as D
from patchweave.plans import delta_queries, feed_queries, reader_queries, sql_queries, store_queries  # noqa: F401  (register their queries)
from patchweave.plans.inputs import report_inputs as _report_inputs
from patchweave.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from patchweave.sources import feeds
from patchweave.sources import oval

# ---- matching, by each ordering ----


def match(spark: SparkSession, sf_dir: str, comparer: str) -> DataFrame:
    """name, version, advisory_id, installs, fixed, last_affected of every affected installed version. Versions are
    distinct before the join, so the hottest package costs its versions and not its installs."""
    return M.affected_versions(D.installed(spark, sf_dir, comparer), D.advisories(spark, sf_dir, comparer), comparer)


for _c in D.SHAPES:
    query(D.match_sql(_c), f"match_{_c}")(lambda spark, sf_dir, c=_c: match(spark, sf_dir, c))


@query(
    """
WITH p AS (SELECT p_partkey, CAST(p_size % 5 AS INT) AS v, CAST(p_partkey % 4 AS INT) AS lo, CAST(p_partkey % 7 AS INT) AS hi, CAST(p_partkey % 6 AS INT) AS kind FROM part)
SELECT CASE WHEN kind = 4 THEN 'error' WHEN kind = 5 THEN 'miss' WHEN kind = 3 THEN 'hit'
    WHEN v >= lo AND (hi < lo OR (kind < 2 AND hi = lo) OR v < hi OR (kind = 2 AND v = hi)) AND NOT (kind < 2 AND hi = lo) THEN 'hit' ELSE 'miss' END AS kind, count(*) AS n
FROM p GROUP BY 1
"""
)
def range_walk(spark, sf_dir):
    p = D.table(spark, sf_dir, "part")
    ver = lambda c: F.concat(c.cast("string"), F.lit(".0.0"))
    kind = F.col("p_partkey") % 6
    none = F.lit(None).cast("string")
    ev = lambda i=none, f=none, la=none: F.struct(i.alias("introduced"), f.alias("fixed"), la.alias("last_affected"), none.alias("limit"))
    lo, hi = ver(F.col("p_partkey") % 4), ver(F.col("p_partkey") % 7)
    events = F.when(kind < 2, F.array(ev(i=lo), ev(f=hi))).when(kind == 2, F.array(ev(i=lo), ev(la=hi))).when(kind == 3, F.array(ev(i=F.lit("0")))).when(kind == 4, F.array(ev(i=F.lit("x.y")))).otherwise(F.array(ev(i=F.lit("9.0.0"))))
    rows = p.select(ver(F.col("p_size") % 5).alias("version"), events.alias("events"))
    return R.evaluate(rows, "version", "events", "semver").groupBy("outcome.kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH i AS (SELECT DISTINCT concat('pkg-', l_partkey % 500) AS name, l_linenumber % 4 AS a, l_suppkey % 10 AS b FROM lineitem),
l AS (SELECT concat('GHSA-', p_partkey) AS advisory_id, concat('pkg-', p_partkey % 500) AS name, p_size % 4 AS a, p_partkey % 10 AS b FROM part)
SELECT i.name, concat(i.a, '.', i.b, '.0') AS version, advisory_id FROM i JOIN l ON i.name = l.name AND ((i.a = l.a AND i.b = l.b) OR (i.a = l.b AND i.b = l.a))
"""
)
def enumerated_versions(spark, sf_dir):
    li, p = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "part")
    inv = li.select(F.concat(F.lit("pkg-"), F.col("l_partkey") % 500).alias("name"), F.concat((F.col("l_linenumber") % 4).cast("string"), F.lit("."), (F.col("l_suppkey") % 10).cast("string"), F.lit(".0")).alias("version")).distinct()
    a, b = (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 10).cast("string")
    listed = F.array_distinct(F.array(F.concat(F.lit("v"), a, F.lit("."), b, F.lit(".0")), F.concat(b, F.lit("."), a, F.lit(".0+build"))))
    adv = p.select(F.concat(F.lit("GHSA-"), "p_partkey").alias("advisory_id"), F.concat(F.lit("pkg-"), F.col("p_partkey") % 500).alias("name"), F.explode(listed).alias("listed"))
    # Equal under the ordering, not as strings.
    return M.listed_versions(inv, adv, "semver")


@query(
    """
WITH s AS (SELECT s_suppkey, concat('bin-', s_suppkey % 7) AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN concat('bin-', s_suppkey % 7) ELSE concat('src-', s_suppkey % 5) END AS src FROM supplier),
n AS (SELECT s_suppkey AS package_id, 0 AS name_ord, name AS norm_name FROM s UNION ALL SELECT s_suppkey, 1, src FROM s WHERE src <> name)
SELECT package_id, name_ord, norm_name FROM n
"""
)
def two_name_lookup(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("bin-"), (k % 7).cast("string"))
    src = F.when(k % 3 == 1, name).when(k % 3 == 2, F.concat(F.lit("src-"), (k % 5).cast("string")))
    inv = D.table(spark, sf_dir, "supplier").select(k.alias("package_id"), F.lit("Debian:12").alias("ecosystem"), name.alias("name"), F.lit("1.0").alias("version"), src.alias("source_name"), F.lit(None).cast("string").alias("source_version"))
    return M.lookup_names(inv).select("package_id", "name_ord", "norm_name")


_GUARD_SQL = """
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Conan' WHEN 1 THEN 'npm' WHEN 2 THEN 'Ubuntu:22.04:LTS' WHEN 3 THEN 'Oracle Linux:8' WHEN 4 THEN 'Rocky Linux:8' ELSE 'Go' END AS e,
  CASE o_orderkey % 5 WHEN 0 THEN '1.0+esm1' WHEN 1 THEN '1-1.ksplice1.el8' WHEN 2 THEN '1-1.module_el8' WHEN 3 THEN '1.0~FIPS2' ELSE '1.0.0' END AS v FROM orders)
SELECT e AS ecosystem, v AS version, CASE WHEN e = 'Conan' THEN 'no version ordering for the ecosystem' WHEN e = 'npm' THEN 'the database does not cover the ecosystem'
  WHEN v IN ('1.0+esm1', '1.0~FIPS2') THEN 'a build of a separate maintenance line' WHEN e = 'Oracle Linux:8' AND v = '1-1.ksplice1.el8' THEN 'a build of a separate maintenance line'
  WHEN v = '1-1.module_el8' THEN 'a module build of an unknown stream' END AS skip_reason, count(*) AS n
FROM p GROUP BY ALL
"""


@query(_GUARD_SQL)
def coverage_skip(spark, sf_dir):
    pick = lambda m, options: F.get(F.array(*map(F.lit, options)), (F.col("o_orderkey") % m).cast("int"))
    inv = D.table(spark, sf_dir, "orders").select(
        pick(6, ["Conan", "npm", "Ubuntu:22.04:LTS", "Oracle Linux:8", "Rocky Linux:8", "Go"]).alias("ecosystem"),
        pick(5, ["1.0+esm1", "1-1.ksplice1.el8", "1-1.module_el8", "1.0~FIPS2", "1.0.0"]).alias("version"),
        F.lit(None).cast("string").alias("module_stream"),
    )
    covered = spark.createDataFrame([("Ubuntu:22.04:LTS",), ("Oracle Linux:8",), ("Rocky Linux:8",), ("Go",)], "ecosystem string")
    return M.guard(inv.groupBy("ecosystem", "version", "module_stream").agg(F.count(F.lit(1)).alias("n")), covered).select("ecosystem", "version", "skip_reason", "n")


@query(
    """
WITH h AS (SELECT CAST(p_partkey % 97 AS BIGINT) AS package_id, concat('GHSA-', p_partkey) AS advisory_id, concat('CVE-2024-', p_partkey % 120) AS alias, CAST(p_size % 11 AS DOUBLE) AS score FROM part),
m AS (SELECT package_id, alias, min((score = 0, -score, advisory_id)) AS best, count(*) AS members FROM h GROUP BY ALL)
SELECT package_id, best[3] AS advisory_id, members, concat_ws(',', alias, list_aggregate(list_sort((SELECT list(advisory_id) FROM h WHERE h.package_id = m.package_id AND h.alias = m.alias)), 'string_agg', ',')) AS identifiers FROM m
"""
)
def alias_groups(spark, sf_dir):
    k = F.col("p_partkey")
    hits = D.table(spark, sf_dir, "part").select(
        (k % 97).alias("package_id"), F.lit("GHSA").alias("database"), F.concat(F.lit("GHSA-"), k.cast("string")).alias("advisory_id"), F.array(F.concat(F.lit("CVE-2024-"), (k % 120).cast("string"))).alias("aliases"), F.nullif((F.col("p_size") % 11).cast("double"), F.lit(0.0)).alias("score")
    )
    grouped = M.group_advisories(hits)
    members = grouped.groupBy("package_id", "group_no").agg(F.count(F.lit(1)).alias("members"))
    return grouped.filter("winner").join(members, ["package_id", "group_no"]).select("package_id", "advisory_id", "members", F.array_join("identifiers", ",").alias("identifiers"))


_VECTOR_SQL = """
SELECT p_partkey, ['N','A','L','P'][1 + p_partkey % 4] AS av, ['L','H'][1 + p_partkey % 2] AS ac, ['N','L','H'][1 + p_size % 3] AS pr, ['N','R'][1 + p_size % 2] AS ui,
  ['U','C'][1 + (p_partkey // 4) % 2] AS s, ['H','L','N'][1 + p_partkey % 3] AS c, ['H','L','N'][1 + p_size % 3] AS i, ['N','L','H'][1 + (p_partkey // 3) % 3] AS a FROM part
"""
_CVSS_SQL = f"""
WITH v AS ({_VECTOR_SQL}), w AS (SELECT *, CASE av WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END AS wav, CASE ac WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44 END AS wac, CASE ui WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62 END AS wui,
  CASE WHEN pr = 'N' THEN 0.85::DOUBLE WHEN pr = 'L' THEN CASE s WHEN 'C' THEN 0.68 ELSE 0.62 END ELSE CASE s WHEN 'C' THEN 0.5 ELSE 0.27 END END AS wpr,
  CASE c WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END AS wc, CASE i WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END AS wi, CASE a WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END AS wa FROM v),
x AS (SELECT *, 1 - (1 - wc) * (1 - wi) * (1 - wa) AS isc FROM w),
y AS (SELECT *, CASE s WHEN 'C' THEN 7.52::DOUBLE * (isc - 0.029) - 3.25::DOUBLE * pow(isc - 0.02, 15) ELSE 6.42::DOUBLE * isc END AS impact FROM x),
z AS (SELECT *, least(CASE s WHEN 'C' THEN 1.08::DOUBLE ELSE 1 END * (impact + 8.22::DOUBLE * wav * wac * wpr * wui), 10) AS t FROM y),
q AS (SELECT *, CAST(floor(t * 100000 + 0.5) AS BIGINT) AS n FROM z),
f AS (SELECT p_partkey, CASE WHEN impact <= 0 THEN 0 WHEN n % 10000 = 0 THEN n / 100000 ELSE (n // 10000 + 1) / 10 END AS score FROM q)
"""


def _vectors(spark, sf_dir) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    pick = lambda options, i: F.get(F.split(F.lit(options), ""), (i % len(options)).cast("int"))
    parts = [("AV", pick("NALP", k)), ("AC", pick("LH", k)), ("PR", pick("NLH", z)), ("UI", pick("NR", z)), ("S", pick("UC", F.floor(k / 4))), ("C", pick("HLN", k)), ("I", pick("HLN", z)), ("A", pick("NLH", F.floor(k / 3)))]
    text = F.concat_ws("/", F.lit("CVSS:3.1"), *(F.concat(F.lit(n + ":"), v) for n, v in parts))
    return D.table(spark, sf_dir, "part").select("p_partkey", text.alias("vector"))


@query(_CVSS_SQL + "SELECT p_partkey, CAST(round(score * 10) AS INT) AS tenths, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score >= 0.1 THEN 'low' ELSE 'none' END AS band FROM f")
def cvss3_score(spark, sf_dir):
    # Vectors repeat: each distinct one is scored once.
    v = _vectors(spark, sf_dir)
    scored = v.select("vector").distinct().withColumn("score", S.cvss3_score(F.col("vector")))
    return v.join(scored, "vector").select("p_partkey", F.round(F.col("score") * 10).cast("int").alias("tenths"), S.band_of(F.col("score")).alias("band"))


@query(
    """
WITH w AS (SELECT ['Critical','Urgent','Important','High','Moderate','Medium','Low','bogus'][1 + c_custkey % 8] AS word FROM customer)
SELECT word, CASE WHEN word IN ('Critical','Urgent') THEN 'critical' WHEN word IN ('Important','High') THEN 'high' WHEN word IN ('Moderate','Medium') THEN 'medium' WHEN word = 'Low' THEN 'low' ELSE 'unknown' END AS band,
  word IN ('Critical','Urgent','Important','High') AS at_or_above_high, count(*) AS n FROM w GROUP BY ALL
"""
)
def vendor_word_band(spark, sf_dir):
    words = F.array(*map(F.lit, ["Critical", "Urgent", "Important", "High", "Moderate", "Medium", "Low", "bogus"]))
    w = D.table(spark, sf_dir, "customer").select(F.get(words, (F.col("c_custkey") % 8).cast("int")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    band = S.band_of(S.vector_score(F.lit("VENDOR_WORD"), F.col("word")))
    return w.select("word", band.alias("band"), S.at_or_above(band, "high").alias("at_or_above_high"), "n")


@query(
    """
WITH f AS (SELECT o_orderkey AS finding_id, concat('CVE-2024-', o_custkey % 300) AS cve, CASE WHEN o_totalprice > 200000 THEN 7.5::DOUBLE ELSE 4.0 END AS score FROM orders),
r AS (SELECT concat('CVE-2024-', c_custkey % 200) AS cve, [9.0::DOUBLE, 7.0, 4.0, 0.1][CAST(1 + c_nationkey % 4 AS INT)] AS score, NULL::DOUBLE AS epss, false AS kev FROM customer
  UNION ALL SELECT concat('CVE-2024-', s_suppkey % 200), NULL, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 10 AS DOUBLE) / 10 END, false FROM supplier
  UNION ALL SELECT concat('CVE-2024-', s_suppkey % 50), NULL, NULL, true FROM supplier WHERE s_suppkey % 2 = 0),
b AS (SELECT cve, max(score) AS score, max(epss) AS max_epss, bool_or(kev) AS kev, count(*) AS ratings, count(DISTINCT score) > 1 AS disagree FROM r GROUP BY cve)
SELECT finding_id, greatest(f.score, coalesce(b.score, 0)) AS score, max_epss, coalesce(kev, false) AS kev, CAST(coalesce(ratings, 0) AS INT) AS ratings, coalesce(disagree, false) AS disagree FROM f LEFT JOIN b USING (cve)
"""
)
def rating_join(spark, sf_dir):
    """A rating may raise a score; one without vectors (EPSS, KEV) cannot."""
    cve = lambda c, m: F.concat(F.lit("CVE-2024-"), (F.col(c) % m).cast("string"))
    f = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.array(F.lit("GHSA-1"), cve("o_custkey", 300)).alias("identifiers"), F.when(F.col("o_totalprice") > 200000, 7.5).otherwise(4.0).alias("score"))
    s, null = D.table(spark, sf_dir, "supplier"), F.lit(None)
    words = F.array(*map(F.lit, ["Critical", "High", "Medium", "Low"]))
    empty = F.array().cast("array<struct<type:string,score:string>>")
    word = F.array(F.struct(F.lit("VENDOR_WORD").alias("type"), F.get(words, (F.col("c_nationkey") % 4).cast("int")).alias("score")))
    row = lambda key, source, severity, epss, model, kev: [key.alias("cve"), F.lit(source).alias("source"), severity.alias("severity"), epss.cast("double").alias("epss"), model.cast("string").alias("epss_model"), F.lit(kev).alias("kev")]
    nvd = D.table(spark, sf_dir, "customer").select(*row(cve("c_custkey", 200), "NVD", word, null, null, False))
    epss = s.select(*row(cve("s_suppkey", 200), "EPSS", empty, (F.col("s_suppkey") % 10).cast("double") / 10, F.when(F.col("s_suppkey") % 3 > 0, "v4"), False))
    kev = s.filter("s_suppkey % 2 = 0").select(*row(cve("s_suppkey", 50), "KEV", empty, null, null, True))
    out = X.join_ratings(f, nvd.unionByName(epss).unionByName(kev))
    return out.select("finding_id", "score", "max_epss", "kev", F.col("n_ratings").alias("ratings"), "disagree")


@query(
    """
WITH e AS (SELECT DISTINCT concat('CVE-1-', s_suppkey % 40) AS cve, 'KISA' AS source, concat('t', s_suppkey % 3) AS title, '' AS summary, concat('u', s_suppkey % 2) AS url, CAST(1 AS INT) AS claims FROM supplier),
f AS (SELECT c_custkey AS finding_id, c_custkey % 50 AS a, c_custkey % 45 AS b FROM customer),
x AS (SELECT DISTINCT finding_id, source, title, summary, url, claims FROM f JOIN e ON e.cve = concat('CVE-1-', a) OR e.cve = concat('CVE-1-', b))
SELECT finding_id, coalesce(string_agg(concat(source, ':', title, ':', url), ',' ORDER BY source, title, url, summary) FILTER (source IS NOT NULL), '') AS enrichment FROM f LEFT JOIN x USING (finding_id) GROUP BY 1
"""
)
def enrichment_join(spark, sf_dir):
    cve = lambda c, m: F.concat(F.lit("CVE-1-"), (F.col(c) % m).cast("string"))
    k = F.col("s_suppkey")
    e = D.table(spark, sf_dir, "supplier").select(cve("s_suppkey", 40).alias("cve"), F.lit("KISA").alias("source"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("title"), F.lit("").alias("summary"), F.concat(F.lit("u"), (k % 2).cast("string")).alias("url"), F.lit(1).alias("claims"))
    f = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding_id"), F.array(cve("c_custkey", 50), cve("c_custkey", 45), F.lit("X-1")).alias("identifiers"))
    out = X.join_enrichment(f, e)
    return out.select("finding_id", F.array_join(F.transform("enrichment", lambda x: F.concat_ws(":", x["source"], x["title"], x["url"])), ",").alias("enrichment"))


@query(
    """
WITH r AS (SELECT l_orderkey AS finding_id, CASE WHEN l_linenumber % 4 = 0 THEN '1.2.3' ELSE '' END AS fixed, ['wont-fix','not-fixed','unknown',''][CAST(1 + l_suppkey % 4 AS INT)] AS fix_state FROM lineitem),
s AS (SELECT finding_id, bool_or(fixed <> '') AS f, bool_or(fixed = '' AND fix_state = 'wont-fix') AS w, bool_or(fixed = '' AND fix_state = 'not-fixed') AS n FROM r GROUP BY 1)
SELECT finding_id, CASE WHEN f THEN 'fixed' WHEN w THEN 'wont-fix' WHEN n THEN 'not-fixed' ELSE 'unknown' END AS fix_state, NOT f AS unfixable FROM s
"""
)
def fix_state(spark, sf_dir):
    states = F.array(*map(F.lit, ["wont-fix", "not-fixed", "unknown", ""]))
    r = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.when(F.col("l_linenumber") % 4 == 0, "1.2.3").otherwise("").alias("fixed"), F.get(states, (F.col("l_suppkey") % 4).cast("int")).alias("fix_state"))
    kinds = r.groupBy("finding_id").agg(F.collect_set(F.struct("fixed", "fix_state")).alias("ratings"))  # at most 8 different ones
    return kinds.select("finding_id", M.fix_state("ratings").alias("fix_state"), (~F.exists("ratings", lambda x: x["fixed"] != "")).alias("unfixable"))


_SUMMARY_SQL = """
WITH f AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS target_id, CAST(floor(o_totalprice) AS BIGINT) % 6 AS b, o_orderstatus AS s, o_orderpriority LIKE '1%' AS kev, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS epss FROM orders),
g AS (SELECT target_id, count(*) AS findings, count_if(b = 5) AS critical, count_if(b = 4) AS high, count_if(b = 3) AS medium, count_if(b = 2) AS low, count_if(b = 1) AS none, count_if(b = 0) AS unknown,
  count_if(s <> 'F') AS unfixable, count_if(s = 'P') AS wont_fix, count_if(kev) AS kev, max(epss) AS max_epss, max(CASE WHEN b > 0 THEN b - 1 END) AS worst FROM f GROUP BY 1),
k AS (SELECT CAST(s_suppkey % 52 AS BIGINT) AS target_id, count_if(s_suppkey % 3 = 0) AS whole_skips, count_if(s_suppkey % 3 > 0) AS incomplete_checks, count_if(s_suppkey % 4 = 0) AS target_skips FROM supplier GROUP BY 1),
t AS (SELECT CAST(c_custkey % 52 AS BIGINT) AS target_id, count(*) AS components, count(*) - count_if(c_nationkey = 0) AS cataloged, count_if(c_nationkey = 0) AS skipped_no_version, bool_and(c_custkey % 52 % 7 = 0) AS eol FROM customer GROUP BY 1),
s AS (SELECT t.*, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(none, 0) AS none, coalesce(unknown, 0) AS unknown,
  coalesce(unfixable, 0) AS unfixable, coalesce(wont_fix, 0) AS wont_fix, coalesce(kev, 0) AS kev, max_epss, worst, coalesce(incomplete_checks, 0) AS incomplete_checks, cataloged - coalesce(whole_skips, 0) AS evaluated,
  greatest(0, components - (cataloged - coalesce(whole_skips, 0))) AS not_evaluated, skipped_no_version + coalesce(target_skips, 0) AS target_incomplete FROM t LEFT JOIN g USING (target_id) LEFT JOIN k USING (target_id))
"""


_SUMMARY = ["target_id", "components", "findings", "critical", "high", "medium", "low", "none", "unknown", "unfixable", "wont_fix", "kev", "max_epss", "evaluated", "not_evaluated", "incomplete_checks", "target_incomplete"]


@query(_SUMMARY_SQL + "SELECT " + ", ".join(c if c in ("target_id", "max_epss") else f"CAST({c} AS BIGINT) AS {c}" for c in _SUMMARY) + " FROM s")
def summary(spark, sf_dir):
    return P.summarise(*_report_inputs(spark, sf_dir)).select(*_SUMMARY)


@query(_SUMMARY_SQL + "SELECT target_id, CASE WHEN (components > 0 AND evaluated <= 0) THEN 2 WHEN coalesce(max_epss >= 0.99, false) OR coalesce(worst >= 4, false) OR eol THEN 1 ELSE 0 END AS verdict FROM s")
def verdict(spark, sf_dir):
    """Exit code per target: a scan that can't be trusted outranks findings; then the gates."""
    gates = P.Gates(fail_on="critical", fail_on_epss=0.99, fail_on_eol=True)
    return P.summarise(*_report_inputs(spark, sf_dir)).select("target_id", P.verdict(gates).alias("verdict"))


#: Each gate alone, with what closes it in SQL over a summary row, and the code that it gives.
_GATES = {
    "fail_on": ("HIGH", "coalesce(worst >= 3, false)", 1), "fail_on_epss": (0.5, "coalesce(max_epss >= 0.5, false)", 1), "fail_on_kev": (True, "kev > 0", 1), "fail_on_unknown": (True, "unknown > 0", 1), "fail_on_unfixable": (True, "unfixable > 0", 1),
    "fail_on_wont_fix": (True, "wont_fix > 0", 1), "fail_on_eol": (True, "eol", 1), "fail_on_incomplete": (True, "(not_evaluated > 0 OR incomplete_checks > 0)", 2), "fail_on_incomplete_target": (True, "target_incomplete > 0", 2),
}


@query(_SUMMARY_SQL + "SELECT target_id, " + ", ".join(f"CASE WHEN components > 0 AND evaluated <= 0 THEN 2 WHEN {sql} THEN {code} ELSE 0 END AS {gate}" for gate, (_, sql, code) in _GATES.items()) + " FROM s")
def gate_rules(spark, sf_dir):
    """Exit code per target with each gate alone; the summary is worked out once."""
    return P.summarise(*_report_inputs(spark, sf_dir)).select("target_id", *(P.verdict(P.Gates(**{gate: value})).alias(gate) for gate, (value, *_) in _GATES.items()))


@query(
    """
SELECT CAST(o_custkey % 50 AS BIGINT) AS target_id, concat('GHSA-', o_orderkey) AS rule_id, CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 6 >= 4 THEN 'error' WHEN CAST(floor(o_totalprice) AS BIGINT) % 6 IN (1, 2) THEN 'note' ELSE 'warning' END AS level,
  CASE WHEN o_orderkey % 2 = 0 THEN 'a/b.lock' ELSE concat('npm/p', o_orderkey % 1000) END AS uri, sha256(concat('npm', chr(0), 'p', o_orderkey % 1000, chr(0), '1.0.0', chr(0), 'GHSA-', o_orderkey, chr(0), CASE WHEN o_orderkey % 2 = 0 THEN 'a/b.lock' ELSE '' END)) AS fingerprint FROM orders
"""
)
def sarif_results(spark, sf_dir):
    return P.sarif_results(_report_inputs(spark, sf_dir)[0]).drop("message")


@query(
    """
SELECT CAST(s_suppkey % 52 AS BIGINT) AS target_id, concat('skipped-', CASE WHEN s_suppkey % 4 = 0 THEN 'target' ELSE 'coverage' END) AS rule_id, s_suppkey % 3 = 0 AS invocation,
  CASE WHEN s_suppkey % 3 = 0 THEN concat(s_name, ' was not evaluated: why') ELSE concat(s_name, ' was not checked for A-1: why') END AS message FROM supplier
"""
)
def skip_notes(spark, sf_dir):
    return P.skip_notes(_report_inputs(spark, sf_dir)[1]).drop("level")


@query(
    """
SELECT CAST(o_custkey % 50 AS BIGINT) AS target_id, concat(rpad(concat('p', o_orderkey % 1000), 24, ' '), '  ', rpad('1.0.0', 16, ' '), '  GHSA-', o_orderkey, ' (CVE-1)  ',
  CASE CAST(floor(o_totalprice) AS BIGINT) % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'none (5.0)' WHEN 2 THEN 'low (5.0)' WHEN 3 THEN 'medium (5.0)' WHEN 4 THEN 'high (5.0)' ELSE 'critical (5.0)' END, '  fix: ', CASE o_orderstatus WHEN 'F' THEN '2.0.0' WHEN 'P' THEN 'won''t fix' ELSE 'none' END) AS line FROM orders
"""
)
def table_report(spark, sf_dir):
    return P.table_lines(_report_inputs(spark, sf_dir)[0]).drop("position")


@query(
    """
SELECT CAST(s_suppkey % 52 AS BIGINT) AS target_id, concat('{"package":{"name":"', s_name, '"},', CASE WHEN s_suppkey % 3 > 0 THEN '"advisoryId":"A-1",' ELSE '' END, '"reason":"why","cause":"', CASE WHEN s_suppkey % 4 = 0 THEN 'target' ELSE 'coverage' END, '"}') AS text FROM supplier
UNION ALL SELECT CAST(o_custkey % 50 AS BIGINT), concat('{"package":{"name":"p', o_orderkey % 1000, '","version":"1.0.0","ecosystem":"npm"', CASE WHEN o_orderkey % 2 = 0 THEN ',"location":"a/b.lock"' ELSE '' END, '},"advisory":{"id":"GHSA-', o_orderkey, '","aliases":["CVE-1"]},"severity":"', ['unknown','none','low','medium','high','critical'][CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 6 AS INT)],
  '","score":5.0,"evidence":{', CASE WHEN o_orderstatus = 'F' THEN '"fixed":"2.0.0"' ELSE '' END, '},"ratings":[],"enrichment":[],"unfixable":', CASE WHEN o_orderstatus = 'F' THEN 'false' ELSE 'true' END, ',"fixState":"', CASE WHEN o_orderstatus = 'P' THEN 'wont-fix' ELSE 'unknown' END, '"}') FROM orders
"""
)
def json_report(spark, sf_dir):
    findings, skips, targets = _report_inputs(spark, sf_dir)
    return P.json_records(findings, skips, P.summarise(findings, skips, targets)).filter("part <> 'summary'").select("target_id", "text")


@query(
    """
WITH e AS (SELECT n_nationkey AS release, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE concat('20', 15 + n_nationkey % 12, '-06-01') END AS eol_from, n_nationkey % 5 = 0 AS is_maintained FROM nation)
SELECT c_custkey AS target_id, release IS NOT NULL AND d = 'debian' AS known, CASE WHEN d = 'debian' OR (d = 'sles' AND v % 5 = 0) THEN CASE WHEN d = 'sles' THEN concat(v, '.0') ELSE v::VARCHAR END WHEN d = 'sles' THEN concat(v, '.', v % 5) END AS release,
  d = 'debian' AND coalesce(TRY_CAST(eol_from AS DATE) < DATE '2024-01-01', false) AS eol, d = 'debian' AND coalesce(is_maintained, false) AS maintained
FROM (SELECT c_custkey, ['debian', 'sles', 'plan9'][1 + c_custkey % 3] AS d, c_nationkey + 3 AS v FROM customer) c LEFT JOIN e ON release = v
"""
)
def eol_status(spark, sf_dir):
    k = F.col("n_nationkey")
    releases = D.table(spark, sf_dir, "nation").select(F.lit("debian").alias("distro_id"), k.cast("string").alias("release"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("20"), (15 + k % 12).cast("string"), F.lit("-06-01"))).alias("eol_from"), F.lit("").alias("eoes_from"), (k % 5 == 0).alias("is_maintained"))
    v = F.col("c_nationkey") + 3
    distro = F.get(F.array(F.lit("debian"), F.lit("sles"), F.lit("plan9")), (F.col("c_custkey") % 3).cast("int"))
    targets = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), distro.alias("distro_id"), F.when(distro == "sles", F.concat(v.cast("string"), F.lit("."), (v % 5).cast("string"))).otherwise(v.cast("string")).alias("version_id"), F.lit(None).cast("string").alias("pretty_name"))
    return T.eol_status(targets, releases, "2024-01-01").select("target_id", "known", "release", "eol", "maintained")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_write_wins(spark, sf_dir):
    """An aggregate with partial folding instead of a window: a hot key costs no sort."""
    rows = D.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("seq"))
    return C.last_writes(rows, ["user_id", "event_type"], "seq").drop("seq")


@query("SELECT concat('CVE-', l_partkey % 1000) AS cve, l_orderkey * 10 + l_linenumber AS notice, CAST(l_quantity AS INT) % 5 AS claims FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey % 1000 ORDER BY CAST(l_quantity AS INT) % 5 = 0, CAST(l_quantity AS INT) % 5, l_orderkey * 10 + l_linenumber) = 1")
def narrowest_notice(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("CVE-"), (F.col("l_partkey") % 1000).cast("string")).alias("cve"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("notice"), (F.col("l_quantity").cast("int") % 5).alias("claims"))
    return feeds.narrowest(rows)


@query("WITH g AS (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_tax) > 1) SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.l_partkey = l.l_partkey AND g.l_suppkey = l.l_suppkey)")
def ambiguity_drop(spark, sf_dir):
    li, key = D.table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"]
    return oval.drop_ambiguous(li, key, "l_tax", key).select("l_orderkey", "l_linenumber")


@query(
    """
WITH seed AS (SELECT c_custkey % 500 AS cve, ['NVD','EPSS','KEV','RedHat'][1 + c_custkey % 4] AS source, max(c_acctbal) AS score FROM customer GROUP BY ALL),
fresh AS (SELECT s_suppkey % 500 AS cve, 'NVD' AS source, max(s_acctbal) AS score FROM supplier GROUP BY ALL)
SELECT * FROM fresh UNION ALL SELECT * FROM seed s WHERE source NOT IN ('EPSS','KEV') AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.cve = s.cve AND f.source = s.source)
"""
)
def seed_merge(spark, sf_dir):
    sources = F.array(*map(F.lit, ["NVD", "EPSS", "KEV", "RedHat"]))
    seed = D.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 500).alias("cve"), F.get(sources, (F.col("c_custkey") % 4).cast("int")).alias("source")).agg(F.max("c_acctbal").alias("score"))
    fresh = D.table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 500).alias("cve"), F.lit("NVD").alias("source")).agg(F.max("s_acctbal").alias("score"))
    return C.merge_seed(seed, fresh, ["cve", "source"])


@query("SELECT o_orderpriority AS provider, CASE WHEN o_orderpriority NOT LIKE '1%' THEN CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) END AS data_as_of, o_orderpriority LIKE '1%' OR CAST(min(o_orderdate) AS DATE) < DATE '1993-01-01' AS stale FROM orders GROUP BY 1")
def db_age(spark, sf_dir):
    """One load of unknown age makes the whole unknown, and so stale."""
    day = F.when(~F.col("o_orderpriority").startswith("1") | (F.col("o_orderkey") % 7 > 0), F.col("o_orderdate").cast("date"))
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("provider"), day.alias("data_as_of"))
    aged = T.data_as_of(o, ["provider"])
    return aged.select("provider", F.col("data_as_of").cast("string").alias("data_as_of"), T.too_old(F.col("data_as_of"), F.lit("1993-01-01"), 0).alias("__old"), F.coalesce(F.col("data_as_of") < F.lit("1993-01-01").cast("date"), F.lit(True)).alias("stale")).filter("__old = stale").drop("__old")


@query(
    """
SELECT s_suppkey, 'npm' AS type, CASE WHEN s_suppkey % 2 = 0 THEN '@scope' END AS namespace, concat('name', s_suppkey) AS name, CASE WHEN s_suppkey % 3 > 0 THEN concat('1.', s_suppkey, '+x') END AS version, CASE WHEN s_suppkey % 5 = 0 THEN 'a b' END AS arch, 'npm' AS ecosystem FROM supplier
"""
)
def purl_parse(spark, sf_dir):
    k = F.col("s_suppkey")
    text = k.cast("string")
    purl = F.concat(F.lit("pkg:NPM/"), F.when(k % 2 == 0, "%40scope/").otherwise(""), F.lit("name"), text, F.when(k % 3 > 0, F.concat(F.lit("@1."), text, F.lit("+x"))).otherwise(""), F.when(k % 5 == 0, "?arch=a%20b&arch=second").otherwise(""), F.lit("#sub/path"))
    p = D.table(spark, sf_dir, "supplier").select("s_suppkey", N.parse_purl(purl).alias("p"))
    return p.select("s_suppkey", "p.type", "p.namespace", "p.name", "p.version", F.try_element_at("p.qualifiers", F.lit("arch")).alias("arch"), N.purl_ecosystem(F.col("p.type")).alias("ecosystem"))


@query(
    """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN regexp_replace(lower(concat('My__Pkg.-', p_brand)), '[-_.]+', '-', 'g') WHEN 1 THEN lower(concat('My__Pkg.-', p_brand)) ELSE concat('My__Pkg.-', p_brand) END AS norm_name FROM part
"""
)
def name_normalize(spark, sf_dir):
    eco = F.get(F.array(F.lit("PyPI"), F.lit("NuGet"), F.lit("npm")), (F.col("p_partkey") % 3).cast("int"))
    return D.table(spark, sf_dir, "part").select("p_partkey", N.normalize_name(eco, F.concat(F.lit("My__Pkg.-"), "p_brand")).alias("norm_name"))


@query(
    """
WITH d AS (SELECT c_custkey, ['alpine','debian','ubuntu','rhel','sles','opensuse-leap','amzn','plan9'][1 + c_custkey % 8] AS id, ['22.4.1','22.04','sid','2','16.1','15.0','15.6'][1 + c_custkey % 7] AS v FROM customer)
SELECT c_custkey, CASE id WHEN 'alpine' THEN CASE v WHEN '22.4.1' THEN 'Alpine:v22.4' WHEN 'sid' THEN NULL WHEN '2' THEN NULL ELSE concat('Alpine:v', v) END
  WHEN 'debian' THEN CASE WHEN v <> 'sid' THEN concat('Debian:', split_part(v, '.', 1)) END WHEN 'rhel' THEN CASE WHEN v <> 'sid' THEN concat('Red Hat:', split_part(v, '.', 1)) END
  WHEN 'ubuntu' THEN CASE v WHEN '22.04' THEN 'Ubuntu:22.04:LTS' END WHEN 'amzn' THEN CASE v WHEN '2' THEN 'Amazon Linux:2' END
  WHEN 'sles' THEN CASE v WHEN '22.04' THEN 'SLES:22.04' WHEN '16.1' THEN 'SLES:16.1' WHEN '15.0' THEN 'SLES:15' WHEN '15.6' THEN 'SLES:15.SP6' END
  WHEN 'opensuse-leap' THEN CASE WHEN v IN ('22.04', '16.1', '15.0', '15.6') THEN concat('openSUSE Leap:', v) END END AS ecosystem FROM d
"""
)
def distro_ecosystem(spark, sf_dir):
    pick = lambda m, options: F.get(F.array(*map(F.lit, options)), (F.col("c_custkey") % m).cast("int"))
    ids = pick(8, ["alpine", "debian", "ubuntu", "rhel", "sles", "opensuse-leap", "amzn", "plan9"])
    return D.table(spark, sf_dir, "customer").select("c_custkey", N.distro_ecosystem(ids, pick(7, ["22.4.1", "22.04", "sid", "2", "16.1", "15.0", "15.6"])).alias("ecosystem"))


@query("SELECT l_partkey, l_suppkey, sha256(concat(l_partkey, chr(0), l_suppkey, chr(0), min(l_shipdate::DATE))) AS fingerprint FROM lineitem GROUP BY l_partkey, l_suppkey")
def sarif_fingerprint(spark, sf_dir):
    g = D.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("d"))
    return g.select("l_partkey", "l_suppkey", P.fingerprint("l_partkey", "l_suppkey", "d").alias("fingerprint"))


@query(
    """
WITH p AS (SELECT concat('Rocky Linux:', c_nationkey) AS ecosystem, c_nationkey % 3 > 0 AS covered FROM customer)
SELECT ecosystem, count(*) AS packages, count_if(covered) AS covered FROM p GROUP BY 1
"""
)
def coverage_summary(spark, sf_dir):
    """Packages by ecosystem and how many the guard lets through."""
    key = lambda c: F.concat(F.lit("Rocky Linux:"), F.col(c).cast("string")).alias("ecosystem")
    inv = D.table(spark, sf_dir, "customer").select(key("c_nationkey"), F.lit("1.0-1").alias("version"), F.lit(None).cast("string").alias("module_stream"))
    covered = D.table(spark, sf_dir, "nation").filter("n_nationkey % 3 > 0").select(key("n_nationkey"))
    return M.guard(inv, covered).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("packages"), F.count_if(F.col("skip_reason").isNull()).alias("covered"))


_SCAN_SQL = """
WITH i AS (SELECT DISTINCT concat_ws('/', l_partkey % 2000, l_linenumber, CAST(l_quantity AS INT), l_suppkey % 10) AS package_id, l_partkey % 4 AS e, l_partkey % 2000 AS n, l_linenumber % 5 = 4 AND l_partkey % 4 = 0 AS bad, [CAST(l_linenumber AS INT), CAST(l_quantity AS INT), CAST(l_suppkey % 10 AS INT)] AS v FROM lineitem),
a AS (SELECT concat('A-', p_partkey) AS advisory_id, p_partkey % 4 AS e, p_partkey % 2000 AS n, p_size % 5 AS k, [CAST(p_size % 7 AS INT), CAST(p_size AS INT), 0] AS hi, [1, CAST(p_size AS INT), CAST(p_partkey % 10 AS INT)] AS listed FROM part),
x AS (SELECT package_id, advisory_id, e, hi, k, CASE WHEN k = 0 THEN 'advisory' WHEN bad THEN 'target' WHEN v < hi THEN 'hit' ELSE 'miss' END AS o0, CASE WHEN k > 1 THEN 'miss' WHEN bad THEN 'target' WHEN v = listed THEN 'hit' ELSE 'miss' END AS o1 FROM i JOIN a USING (e, n) WHERE e < 3)
SELECT package_id, advisory_id, CASE WHEN o0 = 'hit' THEN 0 WHEN o1 = 'hit' THEN 1 END AS hit_ord, CASE WHEN o0 = 'hit' THEN CASE e WHEN 1 THEN concat(hi[1], '.', hi[2], '-', hi[3]) ELSE concat(hi[1], '.', hi[2], '.', hi[3]) END END AS fixed,
  CASE WHEN o0 IN ('advisory', 'target') THEN o0 WHEN o0 = 'miss' AND o1 = 'target' THEN o1 END AS skip FROM x WHERE o0 <> 'miss' OR o1 <> 'miss'
UNION ALL SELECT package_id, '', NULL, NULL, 'the database does not cover the ecosystem' FROM i WHERE e = 3
"""


@query(_SCAN_SQL)
def scan(spark, sf_dir):
    """The whole way from packages to outcomes: guards, two names, entries with bad bounds, lists, first hits, skips."""
    D.views(spark, sf_dir, "lineitem", "part")
    text = lambda e, a, b, c: f"case {e} when 1 then concat({a}, '.', {b}, '-', {c}) else concat({a}, '.', {b}, '.', {c}) end"
    eco = lambda k: f"case {k} % 4 when 0 then 'npm' when 1 then 'Debian:12' when 2 then 'PyPI' else 'Alpine:v3.99' end"
    own = text("l_partkey % 4", "cast(l_linenumber as int)", "cast(l_quantity as int)", "l_suppkey % 10")
    inv = spark.sql(f"""SELECT DISTINCT concat_ws('/', l_partkey % 2000, l_linenumber, cast(l_quantity as int), l_suppkey % 10) AS package_id, {eco('l_partkey')} AS ecosystem, concat(case l_partkey % 4 when 1 then 'bin-' when 2 then 'Pkg_' else 'pkg-' end, l_partkey % 2000) AS name,
      case when l_linenumber % 5 = 4 and l_partkey % 4 = 0 then 'no version' else {own} end AS version, case when l_partkey % 4 = 1 then concat('pkg-', l_partkey % 2000) end AS source_name, cast(null as string) AS source_version, cast(null as string) AS module_stream FROM lineitem""")
    event = lambda i, f: f"named_struct('introduced', {i}, 'fixed', {f}, 'last_affected', cast(null as string), 'limit', cast(null as string))"
    high = f"case when p_size % 5 = 0 then 'x y' else {text('p_partkey % 4', 'p_size % 7', 'p_size', '0')} end"
    ranges = f"array(named_struct('type', 'ECOSYSTEM', 'events', array({event(chr(39) + '0' + chr(39), 'cast(null as string)')}, {event('cast(null as string)', high)}), 'fix_state', cast(null as string)))"
    listed = text("p_partkey % 4", "1", "p_size", "p_partkey % 10")
    entry = lambda n, r, v, where: f"SELECT 'D' AS database, concat('A-', p_partkey) AS advisory_id, {n} AS aff_ord, {eco('p_partkey')} AS ecosystem, concat('pkg-', p_partkey % 2000) AS name, {r} AS ranges, {v} AS versions, cast(null as string) AS module_stream FROM part {where}"
    adv = spark.sql(entry(0, ranges, "cast(array() as array<string>)", "") + " UNION ALL " + entry(1, f"cast(array() as {M.RANGES})", f"array({listed})", "WHERE p_size % 5 < 2"))
    found, skipped = M.scan(inv, adv, spark.createDataFrame([("npm",), ("Debian:12",), ("PyPI",)], "ecosystem string"))
    rows = found.select("package_id", "advisory_id", F.col("hit.aff_ord").alias("hit_ord"), F.col("hit.outcome.fixed").alias("fixed"), F.col("skip.outcome.cause").alias("skip"))
    return rows.unionByName(skipped.select("package_id", F.lit("").alias("advisory_id"), F.lit(None).cast("int").alias("hit_ord"), F.lit(None).cast("string").alias("fixed"), F.col("skip_reason").alias("skip")))
