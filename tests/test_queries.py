"""Every query against its SQL in DuckDB, over the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pictorium.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted([tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()], key=repr)
    ours = sorted([tuple(plain(row[c]) for c in columns) for row in df.collect()], key=repr)
    assert ours == theirs


def test_no_new_person_without_the_face(spark, tmp_path):
    """Where the face isn't in the table, the query and its SQL agree that nobody is new."""
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").where("not (l_orderkey = 7 and l_linenumber = 1)").write.parquet(f"{tmp_path}/lineitem.parquet")
    os.symlink(f"{SF_DIR}/supplier.parquet", f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{SF_DIR}/supplier.parquet'")
    theirs = con.execute(f"SELECT id, person_name, highlight_img FROM ({registry.ORACLE_SQL['new_person_and_thumbnail']})").fetchall()
    ours = [tuple(r) for r in registry.QUERIES["new_person_and_thumbnail"](spark, str(tmp_path)).select("id", "person_name", "highlight_img").collect()]
    assert sorted(ours) == sorted(theirs) and all(r[1] != "Somebody New" and r[2] is None for r in ours)


def test_names_by_slot_move_no_face(spark):
    """Faces get their candidates' names where they are: none is taken apart and gathered again, no strings are sorted."""
    from pictorium.operators import catalogue as C
    from pictorium.plans import stand_ins as S

    faces = spark.sql("SELECT id, CAST(IF(id = 3, NULL, slice(array(struct(id AS person_id, 0.5D AS weight), struct(9L AS person_id, 0.4D AS weight), struct(1L AS person_id, 0.3D AS weight)), 1, CAST(id AS INT))) AS array<struct<person_id: bigint, weight: double>>) AS candidates FROM range(4)")
    people = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "id long, person_name string")
    out = C.candidate_names(faces, people)
    assert sorted((r.id, *[r[n] for n in C.FACE_NAMES]) for r in out.collect()) == [(0, *["N/A"] * 5), (1, "a", *["N/A"] * 4), (2, "b", *["N/A"] * 4), (3, *["N/A"] * 5)]
    plan = C.candidate_names(faces, S.people(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "hashpartitioning" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
