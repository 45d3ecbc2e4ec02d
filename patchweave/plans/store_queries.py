"""Queries of builds, releases and windows, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchweave.operators import build as B
from patchweave.operators import lifecycle as L
from patchweave.operators import matching as M
from patchweave.operators import report_files as W
from patchweave.operators import reporting as P
from patchweave.operators import store as S
from patchweave.plans import derive as D
from patchweave.plans.inputs import report_inputs as _report_inputs
from patchweave.plans.registry import query
from patchweave.tables import new_path


@query(
    """
WITH o AS (SELECT concat('GHSA/GHSA-', p_partkey, '/0') AS key, p_size AS v FROM part WHERE p_partkey % 9 <> 0), n AS (SELECT concat('GHSA/GHSA-', p_partkey, '/0') AS key, p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS v FROM part WHERE p_partkey % 7 <> 0),
q AS (SELECT concat('CVE-2024-', c_custkey % 900, '/', ['NVD', 'EPSS'][1 + c_custkey % 2]) AS key, max_by(c_acctbal, c_custkey) AS v FROM customer WHERE c_custkey % 3 < 2 GROUP BY 1), r AS (SELECT concat('CVE-2024-', c_custkey % 900, '/', ['NVD', 'EPSS'][1 + c_custkey % 2]) AS key, max_by(c_acctbal, c_custkey) AS v FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1)
SELECT 'affected' AS relation, coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.key = n.key WHERE o.v IS DISTINCT FROM n.v
UNION ALL SELECT 'ratings', coalesce(q.key, r.key), CASE WHEN q.key IS NULL THEN 'added' WHEN r.key IS NULL THEN 'removed' ELSE 'changed' END FROM q FULL JOIN r ON q.key = r.key WHERE q.v IS DISTINCT FROM r.v
"""
)
def snapshot_diff(spark, sf_dir):
    """Two builds of one store, written and read again, and what they don't share."""
    path, null = new_path(spark, "store"), F.lit(None).cast("string")
    k = F.col("p_partkey")
    event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"), null.alias("last_affected"), null.alias("limit"))

    def build(part, customer, size, day):
        fixed = F.concat(size.cast("string"), F.lit(".0.0"))
        ranges = F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(event(F.lit("0"), null), event(null, fixed)).alias("events"), null.alias("fix_state"))).cast(M.RANGES)
        S.write_affected(part.select(F.lit("GHSA").alias("database"), F.concat(F.lit("GHSA-"), k.cast("string")).alias("advisory_id"), F.lit(0).alias("aff_ord"), F.concat(F.lit("npm:"), (k % 3).cast("string")).alias("ecosystem"), F.col("p_name").alias("name"), ranges.alias("ranges"), F.array().cast("array<string>").alias("versions"), null.alias("module_stream")), path)
        source = F.when(F.col("c_custkey") % 2 == 0, "NVD").otherwise("EPSS")
        S.write_ratings(customer.select(F.concat(F.lit("CVE-2024-"), (F.col("c_custkey") % 900).cast("string")).alias("cve"), source.alias("source"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("load_seq")), path)
        return S.open_store(spark, path, S.write_meta(spark, path, day))

    part, customer = D.table(spark, sf_dir, "part"), D.table(spark, sf_dir, "customer")
    old = build(part.filter(k % 9 != 0), customer.filter("c_custkey % 3 < 2"), F.col("p_size"), "2024-01-01")
    new = build(part.filter(k % 7 != 0), customer.filter("c_custkey % 4 < 3"), F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0), "2024-01-02")
    return S.diff(*({**b, "ratings": b["ratings"].drop("load_seq")} for b in (old, new)))


@query(
    """
WITH p AS (SELECT c_nationkey AS target, count(*) AS ratings, CASE WHEN c_nationkey % 4 > 0 THEN DATE '2024-01-10' + CAST(c_nationkey AS INT) END AS since, c_nationkey % 5 > 0 AS known FROM customer WHERE c_nationkey <> 7 GROUP BY 1, 3, 4),
n AS (SELECT c_nationkey AS target, count(*) AS ratings, CASE WHEN c_nationkey % 6 > 0 THEN DATE '2024-01-31' - CAST(c_nationkey AS INT) END AS since, c_nationkey % 11 > 0 AS known FROM customer WHERE c_nationkey % 8 <> 3 OR c_custkey % 2 = 0 GROUP BY 1, 3, 4)
SELECT target, CASE WHEN n.ratings < p.ratings THEN concat('the published one holds ', p.ratings, ' ratings and this one ', n.ratings)
  WHEN p.known AND n.known AND p.since IS NULL THEN concat('the published one covers all of its sources and this one starts at ', n.since)
  ELSE concat('the published one covers from ', p.since, ' and this one only from ', n.since) END AS reason
FROM p JOIN n USING (target) WHERE n.ratings < p.ratings OR (p.known AND n.known AND ((p.since IS NULL AND n.since IS NOT NULL) OR n.since > p.since))
"""
)
def push_guard(spark, sf_dir):
    """Builds that would publish less than what is published, or from later on."""
    c, k = D.table(spark, sf_dir, "customer"), F.col("c_nationkey").cast("int")

    def build(rows, since, known):
        return rows.groupBy(F.col("c_nationkey").alias("target"), since.cast("timestamp").alias("ratings_since"), known.alias("ratings_since_known")).agg(F.count(F.lit(1)).alias("ratings"))

    published = build(c.filter("c_nationkey <> 7"), F.when(k % 4 > 0, F.date_add(F.lit("2024-01-10").cast("date"), k)), k % 5 > 0)
    incoming = build(c.filter("c_nationkey % 8 <> 3 or c_custkey % 2 = 0"), F.when(k % 6 > 0, F.date_add(F.lit("2024-01-31").cast("date"), -k)), k % 11 > 0)
    return S.publish_refusals(published, incoming)


@query(
    """
WITH r AS (SELECT DISTINCT concat(['', 'v'][CAST(1 + p_partkey % 2 AS INT)], p_size % 13, CASE WHEN p_partkey % 3 > 0 THEN concat('.', p_partkey % 12) ELSE '' END) AS release FROM part UNION SELECT n_name FROM nation),
o AS (SELECT release, regexp_extract(release, '^v?([0-9]+)', 1) AS a, regexp_extract(release, '[.]([0-9]+)$', 1) AS b FROM r)
SELECT release, CAST(rank() OVER (ORDER BY a = '', coalesce(TRY_CAST(a AS INT), 0), coalesce(TRY_CAST(b AS INT), 0), CASE WHEN a = '' THEN release ELSE '' END) AS INT) AS place FROM o
"""
)
def release_order(spark, sf_dir):
    """Releases by number, then those that are none; releases that are equal share a place."""
    k = F.col("p_partkey")
    r = D.table(spark, sf_dir, "part").select(F.concat(F.when(k % 2 == 0, "").otherwise("v"), (F.col("p_size") % 13).cast("string"), F.when(k % 3 > 0, F.concat(F.lit("."), (k % 12).cast("string"))).otherwise("")).alias("release"))
    every = r.unionByName(D.table(spark, sf_dir, "nation").select(F.col("n_name").alias("release"))).distinct().withColumn("o", L.release_order(F.col("release")))
    counts = every.groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    # Some hundred releases: each is compared with the others' counts.
    below = every.select("release", F.col("o").alias("mine")).join(F.broadcast(counts), F.col("o") < F.col("mine"), "left").groupBy("release").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return below.select("release", (F.col("n") + 1).cast("int").alias("place"))


@query(
    """
SELECT o_orderpriority AS source, count(*) AS ratings, count(DISTINCT o_custkey) AS cves, CAST(max(CASE WHEN o_orderkey % 3 > 0 AND o_orderpriority NOT LIKE '5%' THEN CAST(o_orderdate AS DATE) END) AS VARCHAR) AS since FROM orders GROUP BY 1
"""
)
def rating_windows(spark, sf_dir):
    """The narrowest window of each source; loads without a start don't narrow it."""
    day = F.when((F.col("o_orderkey") % 3 > 0) & ~F.col("o_orderpriority").startswith("5"), F.col("o_orderdate").cast("date"))
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("cve"), day.alias("since"))
    return L.narrowest_rating(rows).withColumn("since", F.col("since").cast("string"))


@query(
    """
WITH f AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS target_id, count(*) AS n, max(concat('GHSA-', o_orderkey)) AS last_id FROM orders GROUP BY 1), k AS (SELECT CAST(s_suppkey % 52 AS BIGINT) AS target_id, count(*) AS n FROM supplier GROUP BY 1),
t AS (SELECT DISTINCT CAST(c_custkey % 52 AS BIGINT) AS target_id FROM customer)
SELECT t.target_id, coalesce(f.n, 0) AS findings, coalesce(k.n, 0) AS skipped, greatest(coalesce(f.n, 0) - 1, 0) + greatest(coalesce(k.n, 0) - 1, 0) AS commas, last_id, 3::BIGINT AS framing FROM t LEFT JOIN f USING (target_id) LEFT JOIN k USING (target_id)
"""
)
def report_files(spark, sf_dir):
    """JSON reports written by the executors and read again line by line."""
    path = new_path(spark, "reports")
    findings, skips, targets = _report_inputs(spark, sf_dir)
    W.write_reports(W.json_lines_of(findings, skips, P.summarise(findings, skips, targets)), path)
    line = F.regexp_replace("line", "^,", "")
    rows = W.read_lines(spark, path).select(F.col("target_id").cast("long"), F.col("line").startswith(",").alias("comma"), F.from_json(line, "advisory struct<id:string>, package struct<name:string>, cause string, matchedName string").alias("j"), (F.col("line").startswith("{\"schemaVersion\"") | F.col("line").startswith("]")).alias("frame"))
    found, left = F.col("j.matchedName").isNotNull() & ~F.col("frame"), F.col("j.cause").isNotNull() & ~F.col("frame")
    return rows.groupBy("target_id").agg(F.count_if(found).alias("findings"), F.count_if(left).alias("skipped"), F.count_if("comma").alias("commas"), F.max(F.when(found, F.col("j.advisory.id"))).alias("last_id"), F.count_if("frame").alias("framing"))


@query(
    """
WITH a AS (SELECT 'GHSA' AS source, concat('A-', p_partkey) AS id FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT 'mirror', concat('A-', p_partkey) FROM part WHERE p_partkey % 5 = 0),
last AS (SELECT id, max(source) AS source FROM a GROUP BY id),
fresh AS (SELECT concat('CVE-2024-', c_custkey) AS cve, CASE WHEN c_custkey % 3 = 0 THEN 'EPSS' ELSE 'NVD' END AS source FROM customer WHERE c_custkey % 2 = 0),
seed AS (SELECT concat('CVE-2024-', c_custkey) AS cve, ['EPSS', 'NVD', 'Vendor'][1 + c_custkey % 3] AS source FROM customer),
r AS (SELECT * FROM fresh UNION SELECT * FROM seed WHERE source <> 'EPSS')
SELECT 'advisories' AS kind, source, count(*) AS records, NULL AS since, false AS gap, false AS failed FROM last GROUP BY source
UNION ALL SELECT 'ratings', source, count(*), CASE source WHEN 'NVD' THEN '2023-06-01' WHEN 'Vendor' THEN '2022-01-01' END, source = 'NVD', false FROM r GROUP BY source
UNION ALL SELECT 'enrichment', 'notices', count(*), NULL, false, false FROM supplier
UNION ALL SELECT 'enrichment', 'offline', 0, NULL, false, true
"""
)
def build_sources(spark, sf_dir):
    """A build of two providers, two annotators and two sources of enrichment on a seed: what each source gave."""
    from datetime import datetime

    part, customer, supplier = (D.table(spark, sf_dir, t) for t in ("part", "customer", "supplier"))
    null, k = F.lit(None).cast("string"), F.col("p_partkey")

    def entries(which):
        ids = part.filter(which).select(F.lit("A").alias("database"), F.concat(F.lit("A-"), k.cast("string")).alias("advisory_id"), F.lit(0).alias("aff_ord"), F.lit("npm").alias("ecosystem"), F.col("p_name").alias("name"))
        return ids.select("*", F.array().cast(M.RANGES).alias("ranges"), F.array(F.lit("1.0.0")).alias("versions"), null.alias("module_stream"))

    def ratings(which):
        return customer.filter(which).select(F.concat(F.lit("CVE-2024-"), F.col("c_custkey").cast("string")).alias("cve"), F.col("c_acctbal").alias("score"))

    def broken(spark):
        raise OSError("no such host")

    source, path, seed, c = B.Source, new_path(spark, "store"), new_path(spark, "seed"), F.col("c_custkey")
    first = [source("GHSA", B.ADVISORIES, lambda s: entries(k == 1)), source("EPSS", B.RATINGS, lambda s: ratings(c % 3 == 0)), source("NVD", B.RATINGS, lambda s: ratings(c % 3 == 1), since=datetime(2023, 6, 1)), source("Vendor", B.RATINGS, lambda s: ratings(c % 3 == 2), since=datetime(2022, 1, 1))]
    B.build(spark, seed, first, "2024-01-01")
    notices = supplier.select(F.concat(F.lit("CVE-2024-"), F.col("s_suppkey").cast("string")).alias("cve"), F.col("s_name").alias("title"))
    sources = [
        source("GHSA", B.ADVISORIES, lambda s: entries(k % 3 < 2)), source("mirror", B.ADVISORIES, lambda s: entries(k % 5 == 0)), source("EPSS", B.RATINGS, lambda s: ratings((c % 2 == 0) & (c % 3 == 0))),
        source("NVD", B.RATINGS, lambda s: ratings((c % 2 == 0) & (c % 3 != 0)), since=datetime(2023, 1, 1), until=datetime(2023, 2, 1)), source("notices", B.ENRICHMENT, lambda s: notices), source("offline", B.ENRICHMENT, broken),
    ]
    B.build(spark, path, sources, "2024-02-01", seed=seed)
    out = S.open_store(spark, path)["sources"]
    return out.select("kind", "source", "records", F.col("since").cast("date").cast("string").alias("since"), "gap", F.col("error").isNotNull().alias("failed"))
