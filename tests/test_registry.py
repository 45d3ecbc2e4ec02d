"""The library's functions in SQL text."""

from patchweave.functions import registry as R
from patchweave.functions import versions as V


def test_sql_functions(spark):
    names = R.register(spark)
    assert {"comparer_of", "version_key", "version_compare", "version_affected", "severity_band", "normalized_name"} <= set(names)
    row = spark.sql(
        "SELECT comparer_of('npm') a, comparer_of('Alpine:v3.19') b, comparer_of('Alpine') c, normalized_name('PyPI', 'A__b') d, severity_band(9.8D) e, version_compare('npm', '1.10.0', '1.9.0') f, version_compare('Debian:12', '1.0~rc1', '1.0') g, "
        "version_compare('npm', 'x y', '1.0.0') h, version_affected('b', 'a', 'b', true) i, version_affected('b', 'a', 'b', false) j, version_affected('b', null, null, false) k, arrow_version_key('gem', '1.0.a') l"
    ).first()
    assert tuple(row)[:11] == ("semver", "apk", None, "a-b", "critical", 1, -1, None, True, False, True) and row.l == V.gem_key("1.0.a")
    plan = spark.sql("SELECT version_key('npm', cast(id AS string)) k FROM range(5)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "version_key(" not in plan  # inlined
    known = {(r.family, r.comparer, r.style) for r in R.orderings(spark).collect()}
    assert ("RubyGems", "gem", "arrow") in known and ("Debian", "deb", "sql") in known
