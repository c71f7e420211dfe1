"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from scenelake import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == columns
    assert sorted(repr(tuple(row[i] for i in order)) for row in found.fetchall()) == mine


def test_flagship_is_registered():
    import __spark_entry__

    assert registry.FLAGSHIP in __spark_entry__.queries()
