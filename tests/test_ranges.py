"""The column form of range evaluation against the plain walk, over random ranges, and the rules one by one."""

import random

from patchweave.functions import versions as V
from patchweave.operators import ranges as R


def compare(a, b):
    key = lambda s: None if s in ("0", "bad") else tuple(map(int, s.split(".")))
    x, y = key(a), key(b)
    return None if x is None or y is None else (x > y) - (x < y)


def run(spark, cases, comparer="semver"):
    df = spark.createDataFrame([(i, v, comparer, [dict(zip(("introduced", "fixed", "last_affected", "limit"), e)) for e in es]) for i, (v, es) in enumerate(cases)], f"i int, version string, comparer string, events {R.EVENTS}")
    return [tuple(r.outcome) for r in R.evaluate(df, "version", "events", comparer).orderBy("i").collect()]


def test_random_ranges(spark):
    rng = random.Random(3)
    version = lambda: f"{rng.randint(0, 2)}.{rng.randint(0, 3)}.{rng.randint(0, 2)}"
    cases = []
    for _ in range(400):
        es = []
        for _ in range(rng.randint(0, 5)):
            e = [None] * 4
            e[rng.choice([0, 0, 1, 1, 2, 3])] = rng.choice(["0", "bad"]) if rng.random() < 0.15 else version()
            es.append(tuple(e))
        cases.append((version() if rng.random() < 0.9 else "bad", es))
    names = ("introduced", "fixed", "last_affected", "limit")
    want = [R.walk(v, [dict(zip(names, e)) for e in es], compare) for v, es in cases]
    got = run(spark, cases)
    for c, w, g in zip(cases, want, got):
        assert w == g, c


def test_rules(spark):
    e = lambda **k: tuple(k.get(n) for n in ("introduced", "fixed", "last_affected", "limit"))
    got = run(spark, [
        ("not a version", [e(introduced="0")]),
        ("1.5.0", [e(introduced="0"), e(fixed="1.0.0"), e(introduced="1.2.0"), e(last_affected="1.5.0")]),
        ("1.5.0", [e(limit="2.0.0")]),
        ("junk", [e(introduced="0"), e(fixed="1.0.0")]),
        ("1.0.0", [e(introduced="1.0.0"), e(fixed="x.y")]),
    ])
    assert [g[:2] for g in got] == [("hit", None), ("hit", None), ("error", "advisory"), ("error", "target"), ("error", "advisory")]
    assert got[1][2:5] == ("1.2.0", None, "1.5.0")
    assert run(spark, [("1.0-r0", [e(introduced="0"), e(fixed="0")])], "apk")[0][0] == "miss"


def test_maven(spark):
    df = spark.createDataFrame([("1.0-rc1", [{"introduced": "0"}, {"fixed": "1.0"}]), ("1.0", [{"introduced": "0"}, {"fixed": "1.0"}])], f"v string, e {R.EVENTS}")
    assert [r.o.kind for r in df.select(R.evaluate_maven("v", "e").alias("o")).collect()] == ["hit", "miss"]
    assert V.maven_compare("1.0-rc1", "1.0") < 0


def test_intervals_agree_with_the_walk(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    version = lambda: f"{rng.randint(0, 1)}.{rng.randint(0, 2)}.0"
    names = ("introduced", "fixed", "last_affected", "limit")
    cases = []
    for _ in range(400):
        es = [tuple(("0" if rng.random() < 0.1 else version()) if n == k else None for n in names) for k in rng.choices(names, weights=[3, 2, 2, 1], k=rng.randint(0, 6))]
        cases.append((version(), es))
    df = spark.createDataFrame([(i, v, [dict(zip(names, e)) for e in es]) for i, (v, es) in enumerate(cases)], f"i int, version string, events {R.EVENTS}")
    df = df.withColumn("key", V.key("semver", "version")).withColumn("b", R.bounds("events")).withColumn("keys", R.native_keys("semver", "b"))
    df = df.withColumn("ready", R.prepared("events", "keys")).select("i", "key", F.explode(R.intervals("ready")).alias("x")).filter(R.inside("key", "x"))
    got = {}
    for r in df.collect():
        assert r.i not in got  # intervals of a range are disjoint
        got[r.i] = (r.x.introduced, r.x.fixed, r.x.last_affected)
    for i, (v, es) in enumerate(cases):
        kind, _, *bounds, _ = R.walk(v, [dict(zip(names, e)) for e in es], compare)
        if kind != "error":
            assert got.get(i) == (tuple(bounds) if kind == "hit" else None), (v, es)
