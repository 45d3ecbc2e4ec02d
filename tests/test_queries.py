"""Every registered query against its SQL twin in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from patchweave.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(float(x), 6) if isinstance(x, float) else x
    return [columns[i] for i in order], sorted(repr([value(r[i]) for i in order]) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
