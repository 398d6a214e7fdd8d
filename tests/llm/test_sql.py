"""The queries that SQL can express against their SQL, over a small driver table."""

import os

import duckdb
import pytest

from pictorium.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted([tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()], key=repr)
    assert sorted([tuple(row[c] for c in columns) for row in df.collect()], key=repr) == theirs
