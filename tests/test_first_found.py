"""First outcomes decided inside the sweep against those of all pairs."""

import random

import pytest

from patchweave.operators import matching as M
from patchweave.operators import sweep as S
from tests.test_matching import AFF, INV, aff, pkg, rng


def both(spark, inventory, affected):
    """What first_found() gives, which has to be what first_outcomes() gives for found()."""
    inv, a = spark.createDataFrame(inventory, INV), spark.createDataFrame(affected, AFF)
    each = lambda df: sorted(map(repr, df.select("package_id", "database", "advisory_id", "hit", "skip").collect()))
    got = each(M.first_found(inv, a))
    assert got == each(M.first_outcomes(M.found(inv, a)))
    return got


def test_runs_of_points():
    spans = [(0, 9, 0, True, 0), (2, 4, 1, False, 1), (3, 9, 1, True, 2), (5, 7, 2, False, 3)]
    assert S.decided(spans) == [(0, 2, -1, 0), (2, 3, 1, 0), (3, 4, 1, 0), (4, 5, -1, 0), (5, 7, 3, 0), (7, 9, -1, 0)]
    assert S.decided([(1, 2, None, True, 5)]) == [(1, 2, -1, 5)] and S.decided([(1, 3, None, False, 0), (1, 2, None, True, 1)]) == [(1, 2, 0, -1), (2, 3, 0, -1)]


@pytest.mark.parametrize("seed", range(2))
def test_as_all_pairs(spark, monkeypatch, seed):
    """Two names, names that read alike, packages that repeat, advisories of several names, streams, lists, ranges that
    can't be read, versions without a key, and ranges cut at every few points."""
    monkeypatch.setattr(S, "LEAST_POINTS", 30)
    monkeypatch.setattr(S, "RANGE_POINTS", 20)
    monkeypatch.setattr(S, "RUN", 2)
    monkeypatch.setattr(S, "BATCH", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    r = random.Random(seed)
    versions = ["1.0.0", "1.2.0", "2.0.0", "2.0.0-rc.1", "3.1.0", "x y", "1.0", "dev-main", "", "1.0.0-1.module+el8"]
    ecosystems = ["npm", "PyPI", "Debian:12", "Packagist", "Maven", "Red Hat:9", "Alpine:v3.19"]
    names = ["a", "b", "A_b", "a-b", "c"]
    some = lambda xs, no: r.choice([*xs, *[None] * no])
    inventory = [pkg(i, r.choice(ecosystems), r.choice(names), r.choice(versions), some([*names, ""], 8), some(versions, 3), some(["s"], 12)) for i in range(120)]
    inventory += inventory[:10]
    event = lambda: {r.choice(["introduced", "fixed", "last_affected", "limit"]): r.choice([*versions[:5], *versions[:5], "0", "0", "x y", "dev-main"])}
    ranges = lambda: [rng(*([{"introduced": "0"}] * r.randint(0, 1)), *(event() for _ in range(r.randint(0, 3))), type=r.choice(["ECOSYSTEM"] * 4 + ["GIT"]), fix_state=some(["wont-fix"], 3)) for _ in range(r.randint(0, 3))]
    affected, eco = [], {}
    for i in range(50):
        for o in range(r.randint(1, 3)):
            e = eco.setdefault(i, r.choice(ecosystems)) if r.random() < 0.9 else r.choice(ecosystems)
            affected.append(aff(f"X-{i}", e, names[i % 5] if r.random() < 0.8 else r.choice(names), ranges(), r.sample(versions, r.choice([0, 0, 1, 3])), o, some(["s"], 12), "D"))
    try:
        assert len(both(spark, inventory, affected)) > 200
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_start_from_zero_is_swept(spark):
    """"0" is no semver version, yet no bound either: such a range needs no look at pairs."""
    entry = aff("X", "npm", "a", [rng({"introduced": "0"}, {"fixed": "2.0.0"}, {"limit": "3.0.0"})])
    assert not M._keyed_ranges(spark.createDataFrame([entry], AFF)).first().odd
    assert len(both(spark, [pkg(1, "npm", "a", "1.0.0"), pkg(2, "npm", "a", "2.0.0"), pkg(3, "npm", "a", "no")], [entry])) == 2


def test_pairs_are_not_shuffled(spark):
    """A thousand packages and a hundred advisories of one name, with two entries each: 10^5 pairs, none of which meets
    a join, a sort or a shuffle."""
    inv = spark.range(1000).selectExpr("id package_id", "'npm' ecosystem", "'a' name", "concat('1.', id, '.0') version", "cast(null as string) source_name", "cast(null as string) source_version", "cast(null as string) module_stream")
    adv = spark.createDataFrame([aff(f"X-{i}", "npm", "a", [rng({"introduced": "0"}, {"fixed": f"1.{500 + i}.0"})], ["1.999.0"] * o, o) for i in range(100) for o in range(2)], AFF)
    got = M.first_found(inv, adv)
    assert got.count() == sum(500 + i + 1 for i in range(100))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan and "Window" not in plan and "Aggregate" not in plan.split("MapInArrow")[0]
