"""Chains in ascending order: all pairs have to compare so; strings that are no versions have no key."""

import itertools

import pytest

from patchweave.functions import versions as V

CHAINS = {
    "semver": ["0.0.0-0", "0.0.1", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "v1.0.0", "1.0.1", "1.2", "1.10.0", "2", "99999999999999999999.0.0"],
    "pep440": ["1.dev0", "1.0.dev456", "1.0a1", "1.0a2.dev456", "1.0a12", "1.0b1.dev456", "1.0b2", "1.0b2.post345", "1.0c1", "1.0", "1.0+abc.5", "1.0+abc.7", "1.0+5", "1.0.post456.dev34", "1.0.post456", "1.1.dev1", "1.10", "1!0.1"],
    "deb": ["0~~", "0~", "0", "1.0~beta1~svn1245", "1.0~beta1", "1.0", "1.0-1~bpo1", "1.0-1", "1.0-1ubuntu1", "1.0-1.1", "1.0a", "1.0+b", "1.2.3", "1.10", "1:0.1"],
    "rpm": ["1.0~rc1", "1.0", "1.0^git1", "1.0.a", "1.0.1", "1.1a", "1.1.1", "1.1.10", "2.0-1", "2.0-2.el8", "2.0-10.el8", "1:0.1-1"],
    "apk": ["1.0_alpha", "1.0_alpha2", "1.0_beta", "1.0_rc1", "1.0", "1.0-r1", "1.0-r10", "1.0_p", "1.0_p1", "1.0a", "1.0b", "1.0.1", "1.1", "1.10", "2.0"],
    "nuget": ["1.0.0-5", "1.0.0-alpha", "1.0.0-Alpha.1", "1.0.0-beta", "1.0.0", "1.0.0.1", "1.0.1", "1.2", "1.10", "2"],
    "gem": ["1.0.a", "1.0.b1", "1.0.b2", "1.0.rc.1", "1", "1.0.1.a", "1.0.1", "1.1", "1.10", "2.0.0.pre1", "2"],
    "composer": ["1.0-dev", "1.0-alpha1", "1.0-alpha2", "1.0-beta", "1.0-RC1", "1.0", "1.0-patch1", "1.0.1", "1.x-dev", "2.0"],
    "maven": ["1-alpha-1", "1-alpha2", "1-beta", "1-milestone", "1-rc1", "1-snapshot", "1", "1-sp", "1-abc", "1-1", "1.1", "1.2", "1.10", "2"],
}
EQUAL = {
    "semver": ["1.0.0", "v1.0.0+build.5", "01.0.0", "1"],
    "pep440": ["1.0", "1", "v1.0.0", "1.0+"[:3]],
    "deb": ["1.0", "0:1.0", "1.00", "1.0-0"],
    "rpm": ["1.0", "0:1.0", "1..0", "1.00", ":1.0"],
    "apk": ["1.2.3", "1.2.3"],
    "nuget": ["1.0", "1.0.0.0", "1.0.0+x", "01.0"],
    "gem": ["1", "1.0", "1.0.0"],
    "composer": ["1.0", "1.0.0.0", "v1.0", "1.0-stable"],
    "maven": ["1", "1.0", "1-ga", "1.0.0-final", "1-release"],
}
INVALID = {
    "semver": ["", "0", "1.2.3.4", "1.02", "1.0.0-01", "a", "1.0.0-"],
    "pep440": ["", "1.0.x", "1,0", "é"],
    "deb": ["", "a1", "1 0", "1.0-", "x:1", "1:", "1_0"],
    "rpm": ["", "1 0", "1.0-", "99999999999999999999:1"],
    "apk": ["", "a", "1.", "1.0_foo", "1.0-1", "1.0-r", "1.0~", "1.0A"],
    "nuget": ["", "1.2.3.4.5", "1.a", "1.0-01", "2147483648", "1.0-"],
    "gem": ["", "a", "1..0", "1.0_0"],
    "composer": ["", "abc", "1.0.0.0.0"],
    "maven": ["", " "],
}


def keys(spark, comparer, versions):
    if comparer in V.NATIVE:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(versions)], "i int, v string")
        return [r.k for r in df.select("i", V.key(comparer, "v").alias("k")).orderBy("i").collect()]
    return [V.PYTHON[comparer](v) for v in versions]


@pytest.mark.parametrize("comparer", CHAINS)
def test_order(spark, comparer):
    chain, equal, invalid = CHAINS[comparer], EQUAL[comparer], INVALID[comparer]
    if comparer == "maven":
        for (i, a), (j, b) in itertools.product(enumerate(chain), repeat=2):
            assert V.maven_compare(a, b) == (i > j) - (i < j), (a, b)
        assert all(V.maven_compare(a, b) == 0 for a in equal for b in equal)
        assert all(V.maven_compare(v, "1") is None for v in invalid)
        return
    found = keys(spark, comparer, chain)
    assert None not in found
    for i, j in itertools.combinations(range(len(chain)), 2):
        assert found[i].encode() < found[j].encode(), (chain[i], chain[j])
    assert len(set(keys(spark, comparer, equal))) == 1
    assert keys(spark, comparer, invalid) == [None] * len(invalid)


def test_composer_branches():
    assert V.composer_key("dev-main") == V.composer_key("DEV-main") == "dev-main"
    assert V.composer_key("master") == "dev-master"


LONG = {
    "semver": ["1." * 500_000 + "0", "1.0.0-" + "a." * 499_000 + "a"],
    "pep440": ["1" + ".1" * 499_000, "1.0+" + "a." * 499_000 + "b"],
    "apk": ["1" + ".1" * 499_000, "1" + "_p" * 499_000, "1.0" + ".0" * 499_000 + "_"],
    "deb": ["1" + ".1" * 499_000, "1" + "-1" * 499_000, "1" + "a1" * 499_000],
    "rpm": ["1" + ".1" * 499_000, "1" + "-1" * 499_000, "1" + "~" * 999_000],
    "nuget": ["1.0.0-" + "a." * 499_000 + "a", "1.0.0+" + "a." * 499_000 + "a", "1.0.0-" + "1." * 499_000],
    "maven": ["1" + ".1" * 499_000, "1" + ".0" * 499_000, "1" + ".0" * 499_000 + ".1", "1" + "-a1" * 300_000],
    "gem": ["1" + ".0" * 499_000 + ".a", "1" + "-" * 999_000],
    "composer": ["1.0-beta" + "1" * 999_000 + "~", "1.0-beta" + ".1" * 499_000],
}


@pytest.mark.parametrize("comparer", sorted(LONG))
def test_versions_of_a_million_characters(spark, comparer):
    """A key or null, in little time and without deep recursion."""
    for text in LONG[comparer]:
        if comparer in V.PYTHON:
            V.PYTHON[comparer](text)
        else:
            spark.createDataFrame([(text,)], "v string").select(V.key(comparer, "v").alias("k")).collect()
    if comparer == "maven":
        deep = "1" + "-1" * 300_000
        assert V.maven_compare(deep, deep + "-1") == -1 and V.maven_compare(deep, deep) == 0 and V.maven_compare("1", deep) == -1
        assert V.maven_compare("1" + "-0" * 100_000, "1") == 0


def test_trailing_zeros_and_capital_words(spark):
    rows = ["1.0.100.0.00", "1.0.100", "1.0.10", "0.0", "0", "10.0", "1.0.0.1"]
    keys = {r.v: r.k for r in spark.createDataFrame([(r,) for r in rows], "v string").select("v", V.key("maven", "v").alias("k")).collect()}
    assert keys["1.0.100.0.00"] == keys["1.0.100"] > keys["1.0.10"] > keys["1.0.0.1"] > keys["0"] == keys["0.0"] and keys["10.0"] > keys["1.0.100"]
    below = V.composer_key("1.0.0-STABLE")
    assert below < V.composer_key("1.0.0-dev") < V.composer_key("1.0.0-stable") == V.composer_key("1.0.0")


def test_mavens_order_has_a_circle():
    """Why unusual Maven versions are compared pair by pair: 1 < 1-x < 1-0-a1 < 1, so that they have neither keys nor ranks."""
    circle = ["1", "1-x", "1-0-a1", "1"]
    assert [V.maven_compare(a, b) for a, b in zip(circle, circle[1:])] == [-1, -1, -1]
