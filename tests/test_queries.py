"""Every query beside its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from thicket import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def normal(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in at] for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    cols = [x[0] for x in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert normal(df.columns, df.collect()) == normal(cols, want.fetchall())
