"""The matcher's rules, one by one."""

import pytest
from pyspark.sql import functions as F

from patchweave.operators import findings as X
from patchweave.operators import matching as M

INV = "package_id long, ecosystem string, name string, version string, source_name string, source_version string, module_stream string"
AFF = f"database string, advisory_id string, aff_ord int, ecosystem string, name string, ranges {M.RANGES}, versions array<string>, module_stream string"


def rng(*events, type="ECOSYSTEM", fix_state=None):
    return {"type": type, "events": [dict(e) for e in events], "fix_state": fix_state}


def aff(id, eco, name, ranges=(), versions=(), ord=0, stream=None, database="D"):
    return (database, id, ord, eco, name, list(ranges), list(versions), stream)


def pkg(i, eco, name, version, source=None, source_version=None, stream=None):
    return (i, eco, name, version, source, source_version, stream)


def run(spark, inventory, affected):
    inv, a = spark.createDataFrame(inventory, INV), spark.createDataFrame(affected, AFF)
    each = lambda df: sorted(map(repr, df.select("package_id", "database", "advisory_id", "name_ord", "aff_ord", "range_ord", "fix_state", "outcome").collect()))
    swept, paired = M.found(inv, a), M.outcomes(M.candidates(inv, a))
    assert each(swept) == each(paired)  # the sweep gives what all pairs give
    rows = M.first_outcomes(swept).collect()
    return {(r.package_id, r.advisory_id): (r.hit and (r.hit.outcome.introduced, r.hit.outcome.fixed), r.skip and r.skip.outcome.cause) for r in rows}


OPEN = rng({"introduced": "0"}, {"fixed": "2.0.0"})


def test_names_versions_and_lists(spark):
    got = run(
        spark,
        [pkg(1, "npm", "a", "1.0.0"), pkg(2, "PyPI", "A.b_c", "1.0"), pkg(3, "npm", "a", "3.0.0"), pkg(4, "Debian:12", "libx1", "2.0-1", "x", "1.0-1"), pkg(5, "RubyGems", "g", "1.0.a"), pkg(6, "Packagist", "c", "dev-main"), pkg(7, "Maven", "m:m", "1.0-rc1"), pkg(8, "Maven", "m:m", "1.0")],
        [
            aff("X-1", "npm", "a", [OPEN]),
            aff("X-2", "PyPI", "a-B-c", [rng({"introduced": "0"}, {"fixed": "1.1"})]),
            aff("X-3", "npm", "a", [], ["3.0.0+build"]),
            aff("X-4", "Debian:12", "x", [rng({"introduced": "0"}, {"fixed": "1.5-1"})]),
            aff("X-5", "RubyGems", "g", [rng({"introduced": "0"}, {"fixed": "1.0"})], ["9.9"]),
            aff("X-6", "Packagist", "c", [rng({"introduced": "0"}, {"fixed": "1.0"})]),
            aff("X-7", "Maven", "m:m", [rng({"introduced": "0"}, {"fixed": "1.0"})], ["1.0.0-ga"]),
        ],
    )
    assert got == {
        (1, "X-1"): (("0", "2.0.0"), None),
        (2, "X-2"): (("0", "1.1"), None),
        (3, "X-3"): ((None, None), None),
        (4, "X-4"): (("0", "1.5-1"), None),
        (5, "X-5"): (("0", "1.0"), None),
        (6, "X-6"): (None, "target"),
        (7, "X-7"): (("0", "1.0"), None),
        (8, "X-7"): ((None, None), None),
    }


def test_first_hit_and_errors(spark):
    bad = rng({"introduced": "0"}, {"fixed": "x.y"})
    got = run(
        spark,
        [pkg(1, "npm", "a", "1.0.0"), pkg(2, "npm", "b", "1.0.0"), pkg(3, "npm", "c", "1.0.0"), pkg(4, "npm", "d", "junk")],
        [
            aff("E", "npm", "a", [bad, OPEN]),  # the first error ends the entry
            aff("F", "npm", "b", [bad], ord=0),
            aff("F", "npm", "b", [OPEN], ord=1),  # another entry hits; the error came before
            aff("G", "npm", "c", [OPEN], ord=0),
            aff("G", "npm", "c", [bad], ord=1),  # met after the hit
            aff("H", "npm", "d", [rng({"introduced": "0"})]),  # no comparison, so any version is hit
            aff("I", "npm", "d", [rng({"introduced": "0"}, type="GIT")]),
        ],
    )
    assert got == {(1, "E"): (None, "advisory"), (2, "F"): (("0", "2.0.0"), "advisory"), (3, "G"): (("0", "2.0.0"), None), (4, "H"): (("0", None), None)}


def test_module_streams(spark):
    el = rng({"introduced": "0"}, {"fixed": "1.0-2.module+el8.5.0+1"})
    got = run(
        spark,
        [pkg(1, "Rocky Linux:8", "n", "1.0-1.module+el8.4.0+9", stream="n:1"), pkg(2, "Rocky Linux:8", "n", "1.0-1", stream=None), pkg(3, "Rocky Linux:8", "n", "1.0-1.module+el8", stream="n:2")],
        [aff("S", "Rocky Linux:8", "n", [el], stream="n:1"), aff("T", "Rocky Linux:8", "n", [el])],
    )
    assert got == {(1, "S"): (("0", "1.0-2.module+el8.5.0+1"), None), (1, "T"): (None, "advisory"), (2, "T"): (None, "advisory"), (3, "T"): (None, "advisory")}


def test_guards(spark):
    inv = spark.createDataFrame([pkg(1, "Conan", "a", "1"), pkg(2, "npm", "a", "1"), pkg(3, "Ubuntu:22.04:LTS", "a", "1.0+esm1"), pkg(4, "Oracle Linux:8", "a", "1-1.ksplice1.el8"), pkg(5, "Rocky Linux:8", "a", "1-1.module_el8"), pkg(6, "Go", "a", "1")], INV)
    covered = spark.createDataFrame([("Go",), ("Ubuntu:22.04:LTS",), ("Oracle Linux:8",), ("Rocky Linux:8",)], "ecosystem string")
    got = {r.package_id: r.skip_reason for r in M.guard(inv, covered).collect()}
    assert [bool(got[i]) for i in range(1, 7)] == [True, True, True, True, True, False]
    assert len(set(got.values())) == 5


@pytest.mark.parametrize("order", [1, -1])
def test_groups_do_not_depend_on_order(spark, order):
    rows = [(1, "GHSA", "GHSA-1", ["CVE-1"], 5.0), (1, "PYSEC", "PYSEC-2", ["CVE-1", "CVE-2"], None), (1, "OSV", "OSV-3", ["CVE-2"], 7.5), (1, "OSV", "OSV-4", [], 9.0), (2, "A", "A-1", None, None), (2, "B", "B-1", ["A-1"], None)]
    df = spark.createDataFrame(rows[::order], "package_id long, database string, advisory_id string, aliases array<string>, score double")
    got = {(r.package_id, r.advisory_id): (r.group_no, r.winner) for r in M.group_advisories(df).collect()}
    assert len({got[1, k][0] for k in ("GHSA-1", "PYSEC-2", "OSV-3")}) == 1 and got[1, "OSV-4"][0] != got[1, "OSV-3"][0]
    assert [k for k, v in got.items() if v[1]] and {k for k, v in got.items() if v[1]} == {(1, "OSV-3"), (1, "OSV-4"), (2, "A-1")}


RATINGS = "cve string, source string, severity array<struct<type:string,score:string>>, epss double, epss_model string, kev boolean"


def test_ratings_of_several_sources(spark):
    word = lambda w: [("VENDOR_WORD", w)]
    ratings = spark.createDataFrame(
        [("CVE-1", "NVD", word("High"), None, None, None), ("CVE-1", "EPSS", [], 0.5, "v", None), ("CVE-1", "old", [], 0.9, "", None), ("CVE-2", "KEV", [], None, None, True), ("CVE-2", "RH", word("Low"), None, None, False), ("CVE-3", "RH", word("Critical"), None, None, False)], RATINGS
    )
    own = "array<struct<database:string,advisory_id:string,band:string,score:double,epss:double,epss_model:string,kev:boolean,no_opinion:boolean>>"
    rows = [(1, ["GHSA-1", "CVE-1"], 5.0), (2, ["CVE-1", "CVE-2", "CVE-1"], None), (3, ["CVE-9"], 4.0), (4, None, None), (5, ["CVE-3", "CVE-9"], 9.9)]
    f = spark.createDataFrame(rows, "finding_id long, identifiers array<string>, score double")
    got = {r.finding_id: r for r in X.join_ratings(f, ratings).collect()}
    assert [(got[i].score, got[i].band, got[i].max_epss, got[i].kev, got[i].n_ratings, got[i].disagree) for i in range(1, 6)] == [
        (7.0, "high", 0.5, False, 3, False), (7.0, "high", 0.5, True, 5, True), (4.0, "medium", None, False, 0, False), (None, "unknown", None, False, 0, False), (9.9, "critical", None, False, 1, False)]
    assert [r.database for r in got[2].ratings] == ["EPSS", "NVD", "old", "KEV", "RH"] or [r.database for r in got[2].ratings] == sorted(r.database for r in got[2].ratings)
    mine = f.filter("finding_id = 3").withColumn("ratings", F.array(F.struct(F.lit("RH").alias("database"), F.lit("A").alias("advisory_id"), F.lit("high").alias("band"), F.lit(8.0).alias("score"), F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("string").alias("fix_state"), F.lit(False).alias("no_opinion"), F.lit(0.1).alias("epss"), F.lit(0.1).alias("epss_percentile"), F.lit("v").alias("epss_model"), F.lit(True).alias("kev"), F.lit(None).cast("date").alias("kev_date_added"), F.lit(None).cast("boolean").alias("kev_ransomware"), F.lit("u").alias("url"))))
    r = X.join_ratings(mine, ratings).first()
    assert (r.score, r.max_epss, r.kev, r.n_ratings, r.disagree, len(r.ratings)) == (8.0, 0.1, True, 1, False, 1) and own


def test_a_cve_with_very_many_ratings(spark):
    """The fold comes before the join: no list of ratings reaches the findings that don't ask for it."""
    n = spark.range(100_000)
    ratings = n.select(F.lit("CVE-1").alias("cve"), F.col("id").cast("string").alias("source"), F.array(F.struct(F.lit("VENDOR_WORD").alias("type"), F.when(F.col("id") % 2 == 0, "Low").otherwise("High").alias("score"))).alias("severity"))
    f = spark.range(50_000).select(F.col("id").alias("finding_id"), F.array(F.lit("CVE-1")).alias("identifiers"), F.lit(1.0).alias("score"))
    out = X.join_ratings(f, ratings).select("finding_id", "score", "disagree", "n_ratings")
    assert out.agg(F.count("*"), F.min("score"), F.min("n_ratings"), F.bool_and("disagree")).first() == (50_000, 7.0, 100_000, True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(rating" not in plan and "collect_list(rs" not in plan
