"""The stream of advisories with state, and findings that follow changes."""

import json

import pytest

from patchweave.operators import delta as D
from patchweave.operators import matching as M
from patchweave.streaming import matching as S
from tests.test_matching import AFF, INV, OPEN, aff, pkg, rng


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def entry(name, fixed):
    return {"aff_ord": 0, "ecosystem": "npm", "name": name, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": fixed}]}], "versions": []}


def test_out_of_order_and_withdrawn_records(rocks, tmp_path):
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    feed.mkdir()
    inventory = rocks.createDataFrame([pkg(1, "npm", "a", "1.0.0"), pkg(2, "npm", "b", "1.0.0")], INV)
    names = S.prepare_inventory(inventory, str(tmp_path / "names"))
    put = lambda n, *rows: (feed / f"{n}.json").write_text("\n".join(json.dumps({"database": "D", "advisory_id": i, "modified": f"2024-01-{d:02d}T00:00:00Z", "withdrawn": w, "entries": json.dumps(e)}) for i, d, w, e in rows))

    state = {}

    def run():
        records = rocks.readStream.schema(S.RECORD).option("maxFilesPerTrigger", 1).json(str(feed))
        q = S.match_changes(S.last_records(records, "1 day"), names, out, str(tmp_path / "checkpoint"))
        q.awaitTermination(180)
        assert q.exception() is None
        state["rows"] = next((p["stateOperators"][0]["numRowsTotal"] for p in reversed(q.recentProgress) if p["stateOperators"]), None)
        return {(r.package_id, r.advisory_id): r.hit.outcome.fixed for r in S.current_findings(rocks, out).collect()}

    put("1", ("X", 5, False, [entry("a", "2.0.0")]), ("Y", 5, None, [entry("b", "1.5.0"), entry("a", "1.1.0")]), (None, 5, False, []))
    assert run() == {(1, "X"): "2.0.0", (2, "Y"): "1.5.0", (1, "Y"): "1.1.0"}
    put("2", ("X", 4, False, [entry("a", "9.0.0")]), ("Y", 6, False, [entry("b", "1.6.0")]))  # an older X; Y no longer names a
    assert run() == {(1, "X"): "2.0.0", (2, "Y"): "1.6.0"}
    put("3", ("X", 7, True, []), ("X", 6, False, [entry("a", "3.0.0")]))
    assert run() == {(2, "Y"): "1.6.0"}
    put("4", ("X", 6, False, [entry("a", "3.0.0")]))  # the tombstone stands
    assert run() == {(2, "Y"): "1.6.0"}
    put("5", ("Z", 30, False, [entry("a", "4.0.0")]))  # the watermark passes the tombstone by
    run()
    put("6", ("Z", 31, False, [entry("a", "5.0.0")]))
    assert run() == {(2, "Y"): "1.6.0", (1, "Z"): "5.0.0"}


def test_changes_give_what_a_full_run_gives(spark):
    old_inv = [pkg(1, "npm", "a", "1.0.0"), pkg(2, "npm", "a", "1.9.0"), pkg(3, "npm", "b", "1.0.0"), pkg(4, "npm", "c", "1.0.0"), pkg(5, "npm", "b", "junk"), pkg(8, "Debian:12", "libx", "1.0-1", "a")]
    new_inv = [pkg(1, "npm", "a", "2.0.0"), *old_inv[1:3], *old_inv[4:], pkg(6, "npm", "c", "0.1.0")]  # 1 changed, 4 gone, 6 new
    later = rng({"introduced": "0"}, {"fixed": "1.5.0"})
    old_aff = [aff("A", "npm", "a", [OPEN]), aff("B", "npm", "b", [OPEN]), aff("C", "npm", "c", [OPEN]), aff("E", "npm", "b", [rng({"introduced": "0"}, {"fixed": "x y"})])]
    new_aff = [aff("A", "npm", "a", [later]), aff("C", "npm", "c", [OPEN]), aff("D", "npm", "b", [later]), old_aff[3]]  # A changed, B withdrawn, D new
    frames = lambda i, a: (spark.createDataFrame(i, INV), spark.createDataFrame(a, AFF))
    old, full = D.findings_of(*frames(old_inv, old_aff)), D.findings_of(*frames(new_inv, new_aff))
    packages = spark.createDataFrame([(1,), (4,), (6,), (99,)], "package_id long")
    advisories = spark.createDataFrame([("D", i) for i in "ABDQ"], "database string, advisory_id string")
    changed = M.write_table(D.changes(old, *frames(new_inv, new_aff), packages, advisories), "test-changes")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(D.apply(old, changed)) == rows(full) and rows(old) != rows(full)
    keys = [(r.op, r.package_id, r.advisory_id) for r in changed.collect()]
    assert ("delete", 4, "C") in keys and ("insert", 6, "C") in keys and not any(i == "E" for _, _, i in keys) and len(keys) == len(set(keys))
    none = D.changes(full, *frames(new_inv, new_aff), packages.filter("false"), advisories.filter("false"))
    assert none.count() == 0


def test_changed_ratings(spark):
    f = spark.createDataFrame([(1, ["CVE-1"]), (2, ["CVE-2", "X"]), (3, ["CVE-3"])], "finding_id long, identifiers array<string>")
    before = spark.createDataFrame([("CVE-1", "NVD", 1.0), ("CVE-2", "NVD", 1.0)], "cve string, source string, score double")
    after = spark.createDataFrame([("CVE-2", "NVD", 2.0), ("CVE-1", "NVD", 1.0), ("CVE-3", "NVD", 1.0)], before.schema)
    assert {r.finding_id for r in D.changed_ratings(f, before, after).collect()} == {2, 3}
