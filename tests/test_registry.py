"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lakecohort.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (bool, int)) else plain(float(v)) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    wanted = sorted([tuple(plain(dict(zip(found.columns, r))[c]) for c in columns) for r in found.fetchall()], key=repr)
    assert got == wanted


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
