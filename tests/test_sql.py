"""Every registered query of the reference operators against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 8) if isinstance(v, float) else str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted([tuple(map(plain, r)) for r in df.select(*cols).collect()], key=key)
    if name not in queries.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
