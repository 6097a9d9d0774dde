"""Every query of the catalogue that has SQL, against DuckDB, on the smallest fixture."""

import math

import duckdb
import pytest

from docloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rel = duck.sql(catalog.ORACLE[name])
    names, columns = sorted(df.columns), list(rel.columns)
    assert names == sorted(columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "id", "rank", "score"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down_and_prune(spark, sf):
    plan = catalog.tokenize_count(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
