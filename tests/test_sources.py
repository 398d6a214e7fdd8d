"""Listings, lists and sections on small files."""

import pytest
from pyspark.sql import functions as F

from pictorium import schema
from pictorium.operators import catalogue as C
from pictorium.operators import training as T
from pictorium.sources import catalogue as tables
from pictorium.sources import files, pictures


def test_listing(spark, tmp_path):
    for name in ("a.jpg", "sub/b.JPEG", "sub/c.png", "sub/.d.jpg", ".hid/e.jpg"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * 3)
    got = files.listing(spark, str(tmp_path))
    assert got.columns == ["path", "modified", "length"]
    assert {r.path for r in got.collect()} == {f"{tmp_path}/a.jpg", f"{tmp_path}/sub/b.JPEG"}
    wanted = spark.createDataFrame([(f"{tmp_path}/a.jpg",)], "path string")
    assert [bytes(r.content) for r in files.contents_of(spark, str(tmp_path), wanted).collect()] == [b"xxx"]


def test_append_unique(spark, tmp_path):
    kind, path = "not_added string, in_database string", str(tmp_path / "list")
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d")], kind)
    files.append_unique(spark, path, rows, kind)
    files.append_unique(spark, path, spark.createDataFrame([("a", "b"), ("e", "f")], kind), kind)
    assert sorted(tuple(r) for r in files.read_csv(spark, path, kind).collect()) == [("a", "b"), ("c", "d"), ("e", "f")]


def test_sections(spark, tmp_path):
    files.write_sections(spark.range(1050).coalesce(1), str(tmp_path / "s"), 500)
    assert len(list((tmp_path / "s").glob("part-*"))) == 3


def test_tables_round_trip(spark, tmp_path):
    tables.save(tables.empty(spark), str(tmp_path))
    assert {n: d.count() for n, d in tables.load(spark, str(tmp_path)).items()} == dict.fromkeys(tables.TABLES, 0)


def test_wide_and_narrow_candidates(spark):
    rows = spark.createDataFrame([(1, [(5, 0.5), (6, 0.25)]), (2, [])], f"id long, candidates {schema.CANDIDATES}")
    wide = schema.wide(rows)
    first = wide.orderBy("id").first()
    assert (first.poss_ident1, first.poss_ident3, first.weight_2, first.weight_3) == (5, None, 0.25, 0.0)
    assert sorted(schema.narrow(wide).select("id", "candidates").collect()) == sorted(rows.collect())


def test_rationals(spark):
    df = spark.createDataFrame([(0.3333,), (None,), (2.5,)], "v double")
    got = [tuple(r.f) for r in df.select(pictures.as_rational(100)(F.col("v")).alias("f")).collect()]
    assert got == [(1, 3), (None, None), (5, 2)]


def test_refusals(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        C.fields(df, ["nope"])
    with pytest.raises(ValueError):
        C.ordered(df, "nope", ["id"])
    with pytest.raises(ValueError):
        C.keyed_path(df, df, df, "nope")
    assert [r.id for r in C.page(df, 1, 1).collect()] == [1]


def test_pairs_are_what_they_say(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 5).alias("label"))
    got = T.pairs(rows, 3, negatives_from=F.col("label") == 0)
    labels = rows.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
    bad = got.join(rows, "id").join(labels, "other").where((F.col("same") == 1) != (F.col("label") == F.col("other_label")))
    assert bad.count() == 0 and got.where("same = 0").count() > 500 and got.where("same = 1").count() == 3995
