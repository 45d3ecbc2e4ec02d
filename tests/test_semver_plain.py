"""Keys of three plain numbers, and comparisons in SQL that work them out once."""

import random

from patchweave.functions import registry as R
from patchweave.functions import versions as V


def test_plain_keys_are_those_of_the_grammar(spark):
    """A build's name doesn't count, but takes a version off the short way: both ways give one key."""
    r = random.Random(4)
    number = lambda: r.choice(["0", "00", "007", "10", "9", "99", "100", "123456789", "000000000", "012345678"])
    plain = [".".join(number() for _ in range(3)) for _ in range(300)]
    rows = spark.createDataFrame([(v, f"{v}+b") for v in plain], "v string, w string").select(V.key("semver", "v").alias("a"), V.key("semver", "w").alias("b")).collect()
    assert all(x.a == x.b and x.a for x in rows)
    odd = ["1.2", "1.2.3.4", "1.2.3\n", " 1.2.3", "1..3", "1.2.", "1.2.1234567890", "1.2.3-a", "v1.2.3", "", "0"]
    got = {x.v: x.k for x in spark.createDataFrame([(v,) for v in odd], "v string").select("v", V.key("semver", "v").alias("k")).collect()}
    assert [v for v in odd if got[v] is None] == ["1.2.3.4", "1.2.3\n", " 1.2.3", "1..3", "1.2.", "", "0"] and got["v1.2.3"] == got["1.2"][:6] + "113~"
    assert got["1.2.1234567890"] > rows[0].a[:0] and got["1.2.3-a"] < got["v1.2.3"]


def test_a_comparison_works_out_each_key_once(spark):
    R.register(spark)
    e = spark.sql("SELECT version_compare('npm', concat(id, '.0.0'), concat(id % 7, '.1.0')) c FROM range(5)")._jdf.queryExecution().optimizedPlan().expressions().apply(0).child()
    left, right = e.children().apply(0), e.children().apply(1)
    assert e.getClass().getSimpleName() == "Subtract"  # no branches above the keys: Spark shares what stands twice
    keys = [[c.canonicalized().toString() for c in (x.child().children().apply(0), x.child().children().apply(1))] for x in (left, right)]
    assert keys[0] == keys[1] or keys[0] == keys[1][::-1]
    assert [r.c for r in spark.sql("SELECT version_compare('npm', concat(id, '.0.0'), concat(id % 7, '.1.0')) c FROM range(8)").collect()] == [-1] * 7 + [1]
