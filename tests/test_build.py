"""Builds of a store from sources and seeds."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from patchweave.operators import build as B
from patchweave.operators import matching as M
from patchweave.operators import store as S


def entries(ids, name="p"):
    def load(spark):
        rows = spark.createDataFrame([(i,) for i in ids], "advisory_id string")
        null = F.lit(None).cast("string")
        return rows.select(F.lit("A").alias("database"), "advisory_id", F.lit(0).alias("aff_ord"), F.lit("npm").alias("ecosystem"), F.lit(name).alias("name"), F.array().cast(M.RANGES).alias("ranges"), F.array(F.lit("1")).alias("versions"), null.alias("module_stream"))

    return load


def ratings(*rows):
    return lambda spark: spark.createDataFrame(rows, "cve string, score double, load_seq int")


def fails(spark):
    raise OSError("no such\nhost")


def listed(store):
    return {(r.kind, r.source): r for r in store["sources"].collect()}


def test_the_last_source_and_the_last_write_count(spark, tmp_path):
    path = str(tmp_path)
    sources = [B.Source("a", B.ADVISORIES, entries(["1", "2"], "a")), B.Source("b", B.ADVISORIES, entries(["2", "3"], "b")), B.Source("N", B.RATINGS, ratings(("C", 1.0, 9), ("C", 2.0, 10))), B.Source("x", B.ENRICHMENT, fails)]
    B.build(spark, path, sources, "2024-01-01")
    store = S.open_store(spark, path)
    assert {(r.advisory_id, r["name"]) for r in store["affected"].collect()} == {("1", "a"), ("2", "b"), ("3", "b")}
    assert [(r.cve, r.source, r.score) for r in store["ratings"].collect()] == [("C", "N", 2.0)]
    got = listed(store)
    assert (got["advisories", "a"].records, got["advisories", "b"].records, got["ratings", "N"].records) == (1, 2, 1)
    assert got["enrichment", "x"].error == "no such host" and got["enrichment", "x"].records == 0


def test_a_failed_build_leaves_nothing(spark, tmp_path):
    path = str(tmp_path)
    good = [B.Source("a", B.ADVISORIES, entries(["1"])), B.Source("N", B.RATINGS, ratings(("C", 1.0, 0)))]
    B.build(spark, path, good, "2024-01-01")
    S.write_keyed(S.open_store(spark, path)["affected"].drop("eco_family"), path, 2)
    S.write_meta(spark, path, "2024-01-01")
    with pytest.raises(OSError):
        B.build(spark, path, [B.Source("a", B.ADVISORIES, entries(["2"])), B.Source("N", B.RATINGS, fails)], "2024-01-02")
    assert [r.advisory_id for r in S.open_store(spark, path)["affected"].collect()] == ["1"]
    # What the failed one wrote isn't taken up, and ranges of other entries don't stay.
    B.build(spark, path, [B.Source("a", B.ADVISORIES, entries(["3"])), good[1]], "2024-01-03")
    assert [r.advisory_id for r in S.open_store(spark, path)["affected"].collect()] == ["3"] and "keyed" not in S.manifest(spark, path)["tables"]
    for wrong in ([good[1]], [B.Source("a", B.ADVISORIES, entries(["1"]), since=None), B.Source("a", B.RATINGS, fails), B.Source("a", B.RATINGS, fails)], [good[0], good[0]], [B.Source("a", "other", fails)]):
        with pytest.raises(S.StoreError):
            B.build(spark, path, wrong, "2024-01-04")


def test_no_advisories_are_no_build(spark, tmp_path):
    none = B.Source("a", B.ADVISORIES, lambda s: entries(["1"])(s).filter("false"))
    with pytest.raises(S.StoreError, match="no advisories"):
        B.build(spark, str(tmp_path), [none], "2024-01-01")
    assert S.builds(spark, str(tmp_path)) == []


def test_only_rating(spark, tmp_path):
    seed, path = str(tmp_path / "seed"), str(tmp_path / "new")
    first = [B.Source("a", B.ADVISORIES, entries(["1", "2"]), data_as_of=datetime(2024, 1, 1)), B.Source("N", B.RATINGS, ratings(("C", 1.0, 0), ("D", 1.0, 0)), since=datetime(2023, 1, 1)), B.Source("EPSS", B.RATINGS, ratings(("C", 0.5, 0)))]
    B.build(spark, seed, first, "2024-01-01")
    rate = B.Source("N", B.RATINGS, ratings(("C", 3.0, 0)), since=datetime(2024, 1, 1))
    with pytest.raises(S.StoreError):
        B.build(spark, path, [rate], "2024-01-02", ratings_only=True)
    with pytest.raises(S.StoreError):
        B.build(spark, path, [first[0]], "2024-01-02", seed, ratings_only=True)
    B.build(spark, path, [rate], "2024-01-02", seed, ratings_only=True)
    store = S.open_store(spark, path)
    assert store["affected"].count() == 2
    assert {(r.cve, r.source): r.score for r in store["ratings"].collect()} == {("C", "N"): 3.0, ("D", "N"): 1.0}
    got = listed(store)
    assert set(got) == {("advisories", "a"), ("ratings", "N")} and got["advisories", "a"].data_as_of == datetime(2024, 1, 1)
    assert got["ratings", "N"].since == datetime(2023, 1, 1) and got["ratings", "N"].records == 2
    assert store["meta"].first()["ratings_since"] == datetime(2023, 1, 1)
