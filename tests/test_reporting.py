"""Summaries, gates, reports, the store and the stream of advisories."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from patchweave.operators import matching as M
from patchweave.operators import findings as X
from patchweave.operators import ranges as R
from patchweave.operators import report_files as W
from patchweave.operators import reporting as P
from patchweave.operators import store as T
from patchweave.streaming import advisories as A

FINDINGS = "target_id long, ecosystem string, name string, version string, advisory_id string, band string, score double, fix_state string, fixed string, identifiers array<string>, kev boolean, max_epss double, location string"
SKIPS = "target_id long, package string, advisory_id string, cause string, reason string"
TARGETS = "target_id long, components long, cataloged long, skipped_no_version long, skipped_no_purl long, eol boolean"


def finding(t, id="A-1", band="high", score=7.5, state="fixed", fixed="2", kev=False, epss=None, name="n", location=None):
    return (t, "npm", name, "1", id, band, score, state, fixed, [id, "CVE-1"], kev, epss, location)


@pytest.fixture(scope="module")
def summary(spark):
    f = spark.createDataFrame([finding(1), finding(1, "A-2", "unknown", None, "wont-fix", "", epss=0.9), finding(2, kev=True, band="low", score=1.0)], FINDINGS)
    s = spark.createDataFrame([(1, "p", "", "coverage", "r"), (3, "q", "", "target", "r"), (3, "q", "A", "advisory", "r")], SKIPS)
    t = spark.createDataFrame([(1, 5, 4, 1, 0, False), (2, 1, 1, 0, 0, True), (3, 1, 1, 0, 0, None), (4, 0, 0, 0, 0, None)], TARGETS)
    return P.summarise(f, s, t).cache()


def test_summary(summary):
    r = {x.target_id: x for x in summary.collect()}
    assert (r[1].findings, r[1].high, r[1].unknown, r[1].unfixable, r[1].wont_fix, r[1].evaluated, r[1].not_evaluated, r[1].target_incomplete) == (2, 1, 1, 1, 1, 3, 2, 1)
    assert (r[3].evaluated, r[3].incomplete_checks, r[3].target_incomplete) == (0, 1, 1) and r[4].findings == 0


@pytest.mark.parametrize(
    ("gates", "codes"),
    [
        (P.Gates(), [0, 0, 2, 0]),
        (P.Gates(fail_on="high"), [1, 0, 2, 0]),
        (P.Gates(fail_on="low"), [1, 1, 2, 0]),
        (P.Gates(fail_on_kev=True), [0, 1, 2, 0]),
        (P.Gates(fail_on_epss=0.9), [1, 0, 2, 0]),
        (P.Gates(fail_on_unknown=True), [1, 0, 2, 0]),
        (P.Gates(fail_on_wont_fix=True, fail_on_unfixable=True), [1, 0, 2, 0]),
        (P.Gates(fail_on_eol=True), [0, 1, 2, 0]),
        (P.Gates(fail_on_incomplete=True, fail_on="low"), [2, 1, 2, 0]),
        (P.Gates(fail_on_incomplete_target=True), [2, 0, 2, 0]),
    ],
)
def test_gates(summary, gates, codes):
    assert [r.c for r in summary.orderBy("target_id").select(P.verdict(gates).alias("c")).collect()] == codes


def test_reports(spark):
    f = spark.createDataFrame([finding(1), finding(1, name="m", location="a/b"), finding(1, "B", "unknown", None, fixed=None)], FINDINGS)
    assert json.loads(P.json_lines(f).first().finding)["identifiers"] == ["A-1", "CVE-1"]
    doc = json.loads(P.sarif_document(P.sarif_results(f), P.sarif_rules(f), "patchweave", "1"))
    run = doc["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["A-1", "B"] and len(run["results"]) == 3
    assert {(r["level"], r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]) for r in run["results"]} == {("error", "npm/n"), ("error", "a/b"), ("warning", "npm/n")}
    assert len({r["partialFingerprints"]["primary"] for r in run["results"]}) == 3
    assert P.explain(f, "B").count() == 1 and P.explain(f, "CVE-1").count() == 3


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    affected = spark.createDataFrame([("D", "X", 0, "npm", "a", [], ["1"], None), ("E", "X", 0, "Debian:12", "a", [], ["1"], None)], f"database string, advisory_id string, aff_ord int, ecosystem string, name string, ranges {M.RANGES}, versions array<string>, module_stream string")
    T.write_affected(affected, path)
    with pytest.raises(T.StoreError):
        T.open_store(spark, path)
    ratings = spark.createDataFrame([("CVE-1", "NVD", 1.0, 1), ("CVE-1", "NVD", 2.0, 2), ("CVE-1", "EPSS", 3.0, 1)], "cve string, source string, score double, load_seq int")
    T.write_ratings(ratings, path)
    T.write_meta(spark, path, "2024-01-01")
    s = T.open_store(spark, path)
    assert {(r.source, r.score) for r in s["ratings"].collect()} == {("NVD", 2.0), ("EPSS", 3.0)}
    assert [r.database for r in T.lookup(s["affected"], "Debian:12", "a").collect()] == ["E"]
    assert s["meta"].first().ecosystems == ["Debian:12", "npm"] and T.guard_publish(s["meta"], s["meta"]) == []
    assert R.EVENTS in M.RANGES


def test_stream(spark, tmp_path):
    feed, table = tmp_path / "feed", str(tmp_path / "table")
    feed.mkdir()
    schema = "database string, advisory_id string, modified timestamp, summary string"
    put = lambda n, *rows: (feed / n).write_text("\n".join(json.dumps(dict(zip(("database", "advisory_id", "modified", "summary"), r))) for r in rows))

    def run():
        q = A.upsert(A.read_stream(spark, str(feed), schema), table, str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        return {(r.advisory_id, r.summary) for r in A.current(spark, table, schema).collect()}

    put("1.json", ("D", "A", "2024-01-01T00:00:00Z", "one"), ("D", "B", "2024-01-01T00:00:00Z", "b"))
    assert run() == {("A", "one"), ("B", "b")}
    put("2.json", ("D", "A", "2024-01-03T00:00:00Z", "two"), ("D", "B", "2024-01-01T00:00:00Z", "b"))
    assert run() == {("A", "two"), ("B", "b")}
    assert all(len(list(b.glob("v=*"))) == 1 for b in (tmp_path / "table").glob("bucket=*"))


def test_builds_of_a_store(spark, tmp_path):
    """A reader sees one build, whole; older ones stay until they are cleared away."""
    path = str(tmp_path / "store")
    affected = lambda *names: spark.createDataFrame([("D", "X", i, "npm", n, [], ["1"], None) for i, n in enumerate(names)], f"database string, advisory_id string, aff_ord int, ecosystem string, name string, ranges {M.RANGES}, versions array<string>, module_stream string")
    ratings = lambda n: spark.createDataFrame([(f"CVE-{i}", "NVD", 1.0, 1) for i in range(n)], "cve string, source string, score double, load_seq int")
    window = lambda since, known=True: spark.createDataFrame([("NVD", since, known)], "source string, since string, since_known boolean").withColumn("since", F.col("since").cast("timestamp"))
    T.write_affected(affected("a", "b"), path)
    with pytest.raises(T.StoreError, match="no ratings"):
        T.write_meta(spark, path, "2024-01-01")
    T.write_ratings(ratings(3), path)
    assert T.write_meta(spark, path, "2024-01-01", window("2024-01-01")) == 1
    old = T.open_store(spark, path)
    T.write_affected(affected("a", "c", "d"), path)
    assert T.open_store(spark, path)["affected"].count() == 2  # not closed yet
    T.write_keyed(affected("a", "c", "d"), path, 4)
    assert T.write_meta(spark, path, "2024-01-02", window("2024-01-05")) == 2 and T.builds(spark, path) == [1, 2]
    new = T.open_store(spark, path)
    assert old["affected"].count() == 2 and new["affected"].count() == 3 and new["ratings"].count() == 3
    assert {(r.key, r.change) for r in T.diff(old, new).collect()} == {("D/X/1", "changed"), ("D/X/2", "added")}
    assert T.guard_publish(old["meta"], new["meta"]) == ["the published one covers from 2024-01-01 and this one only from 2024-01-05"]
    assert T.guard_publish(new["meta"], old["meta"]) == []
    assert T.publish(spark, path, str(tmp_path / "public")) == 1 and "enrichment" not in T.open_store(spark, str(tmp_path / "public"))
    assert T.vacuum(spark, path) >= 2 and T.builds(spark, path) == [2] and T.open_store(spark, path)["affected"].count() == 3
    names = spark.createDataFrame([(1, "npm", "a")], "package_id long, ecosystem string, norm_name string")
    plan = names.hint("merge").join(T.read_keyed(spark, path), ["ecosystem", "norm_name"])
    assert plan.count() == 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text  # the names move, the store doesn't
    assert T.open_store(spark, path, seed=True) and pytest.raises(T.StoreError, T.open_store, spark, str(tmp_path))


def _documents(spark, lines, path):
    """The written reports, put together by target."""
    W.write_reports(lines, path)
    out = {}
    for d in sorted(Path(path).glob("target_id=*")):
        out[int(d.name[10:])] = "".join(f.read_text() for f in sorted(d.glob("part-*")))
    return out


def test_report_files(spark, tmp_path):
    """Documents of several files each, by the fields that readers know."""
    rating = ("ALPINE", "CVE-1", "critical", 9.8, "3.1.4-r6", None, False, None, None, None, None, None, None, None)
    more = "purl string, source_name string, source_version string, layer_digest string, matched_name string, summary string, upstream array<string>, range_type string, introduced string, last_affected string, reason string"
    full = (*finding(1, "CVE-1", "critical", 9.8, fixed="3.1.4-r6", name="libssl3", location="lib/apk/db/installed"), "pkg:apk/x", "openssl", "3.1.4-r5", "sha256:abc", "openssl", "heap overflow", ["U-1"], "ECOSYSTEM", "0", None, "why")
    rows = [full, *((*finding(1, f"A-{i}", "unknown", None, "unknown", ""), *(None,) * 11) for i in range(30)), (*finding(2), *(None,) * 11), (*finding(2), *(None,) * 11)]
    f = spark.createDataFrame(rows, f"{FINDINGS}, {more}")
    f = f.join(spark.createDataFrame([("CVE-1", [rating])], f"advisory_id string, ratings array<{X.RATING}>"), "advisory_id", "left")
    s = spark.createDataFrame([(1, "p", "", "coverage", "r"), (1, "q", "A-9", "target", 'say "x"'), (3, "q", "", "target", "r")], SKIPS)
    t = spark.createDataFrame([(1, 40, 32, 0, 0, False), (2, 2, 2, 0, 0, True), (3, 1, 1, 0, 0, None), (4, 0, 0, 0, 0, None)], TARGETS)
    total = P.summarise(f, s, t)
    eol = spark.createDataFrame([(2, "debian", "12", True, True, False)], "target_id long, distro_id string, release string, known boolean, eol boolean, maintained boolean")
    docs = {k: json.loads(v) for k, v in _documents(spark, W.json_lines_of(f, s, total, eol), str(tmp_path / "json")).items()}
    assert set(docs) == {1, 2, 3, 4} and [len(docs[i]["findings"]) for i in (1, 2, 3, 4)] == [31, 2, 0, 0] and docs[4]["skipped"] == [] and docs[2]["eol"]["eol"] is True and "eol" not in docs[1]
    one = next(x for x in docs[1]["findings"] if x["advisory"]["id"] == "CVE-1")
    assert one == {
        "package": {"name": "libssl3", "version": "1", "ecosystem": "npm", "purl": "pkg:apk/x", "source": {"name": "openssl", "version": "3.1.4-r5"}, "locations": [{"path": "lib/apk/db/installed", "layerDigest": "sha256:abc"}]}, "matchedName": "openssl",
        "advisory": {"id": "CVE-1", "upstream": ["U-1"], "summary": "heap overflow"}, "severity": "critical", "score": 9.8,
        "evidence": {"rangeType": "ECOSYSTEM", "introduced": "0", "fixed": "3.1.4-r6", "reason": "why"}, "ratings": [{"database": "ALPINE", "advisoryId": "CVE-1", "severity": "critical", "score": 9.8, "fixed": "3.1.4-r6", "url": "", "fixState": "fixed"}], "unfixable": False, "fixState": "fixed", "enrichment": [],
    }
    assert list(docs[1]) == ["schemaVersion", "findings", "skipped", "summary"] and docs[1]["skipped"][1] == {"package": {"name": "q"}, "advisoryId": "A-9", "reason": 'say "x"', "cause": "target"}
    sarif = {k: json.loads(v)["runs"][0] for k, v in _documents(spark, W.sarif_lines_of(f, s, total), str(tmp_path / "sarif")).items()}
    assert len(sarif[1]["results"]) == 32 and len(sarif[1]["invocations"][0]["toolExecutionNotifications"]) == 1 and sarif[3]["invocations"][0]["executionSuccessful"] is False and sarif[4]["results"] == []
    assert {r["id"] for r in sarif[1]["tool"]["driver"]["rules"]} >= {"CVE-1", "skipped-target", "skipped-coverage"}
    text = _documents(spark, W.table_lines_of(f, s, total), str(tmp_path / "text"))
    assert W.NOT_CLEAN in text[3] and "no findings; 0 of 0" in text[4] and "31 findings: 1 critical, 30 unknown" in text[1] and "end of life" in text[2] and text[1].index("CVE-1") < text[1].index("31 findings") < text[1].index("was not checked")


def test_thresholds_in_either_case():
    from patchweave.functions import severity

    assert severity.threshold_rank("High") == severity.threshold_rank("high") == 3
    for wrong in ("unknown", "urgent", ""):
        with pytest.raises(ValueError):
            severity.threshold_rank(wrong)
