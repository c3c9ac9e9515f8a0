"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from oracle_check import TABLES, rows_key, spark_type_name

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    assert {f.name: spark_type_name(f.dataType) for f in df.schema.fields} == dtypes
    assert rows_key(df.columns, srows) == rows_key(dcols, drows)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SMALL).count() > 0
