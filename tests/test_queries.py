"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from marlstone import queries as registered

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_sql(spark, con, name):
    df = registered.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(same(r[c]) for c in columns) for r in df.collect())
    found = con.execute(registered.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(same(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_scan_reads_only_what_it_needs(spark):
    plan = registered.queries()["div_filtered"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "PushedFilters: [IsNotNull(l_partkey), Not(EqualTo(l_partkey,0))]" in plan
    assert "TakeOrderedAndProject" in registered.queries()["topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
