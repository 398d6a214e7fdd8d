"""The edit-distance join against all pairs, and medians by counting against NumPy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.operators import catalogue as C
from pictorium.operators import medians as M
from pictorium.operators import names as N
from pictorium.plans import training


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def near(names, d):
    known = sorted({n.lower() for n in names if n is not None})
    return {(a, b, k) for a, b in itertools.combinations(known, 2) if (k := distance(a, b)) <= d}


def random_names(rng, n, alphabet="abé", longest=9, start=""):
    return [start + "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest + 1))) for _ in range(n)]


@pytest.mark.parametrize("d,crowd", [(1, 32), (2, 32), (2, 1), (3, 4)])
def test_all_pairs_within(spark, d, crowd):
    rng = random.Random(d * 100 + crowd)
    names = [*random_names(rng, 90), *random_names(rng, 40, "abcdefghij", 14, "Person-"), "", None, "A", "a", "ab"]
    rows = N.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), d, crowd=crowd).collect()
    assert len(rows) == len(near(names, d)) and {tuple(r) for r in rows} == near(names, d)


def test_names_that_begin_alike_are_parted(spark):
    """All names share their segments but the last: what meets is far less than all pairs."""
    rng = random.Random(2)
    names = sorted({"supplier of things " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400)})
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("length", F.char_length("name"))
    assert {tuple(r) for r in N.similar_names(df, 1).collect()} == near(names, 1)
    plan = N.similar_names(df, 1)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    key = ["length", "k", "piece"]
    met = N.filed(df, 1).join(N.looked_up(df, 1).select(*key, F.col("name").alias("other")), key).select("name", "other").distinct().count()
    assert met >= 400 * 399  # by segments alone
    met = N.left_over(N.filed(df, 1), 1).join(N.left_over(N.looked_up(df, 1), 1).select(*key, "left", F.col("name").alias("other")), [*key, "left"]).where("name <> other").select("name", "other").distinct().count()
    assert met < 400


def test_similar_people(spark):
    people = spark.createDataFrame([(1, "Ann Lee"), (2, "ann lee"), (3, "Ann Leigh"), (4, "Anne Lee"), (5, None), (6, "Bob")], "id long, person_name string")
    assert {tuple(r) for r in N.similar_people(people, 2).collect()} == {(1, 2, 0), (1, 4, 1), (2, 4, 1)}
    assert N.similar_people(people.limit(0)).collect() == []


def test_similar_people_by_name(spark):
    """One row a bearer of a name and one a pair of names; all pairs of people follow."""
    people = [(i, name) for i, name in enumerate(["Ann Lee", "ann lee", "Ann Leigh", "Anne Lee", None, "Bob", "Ann Lees"] * 20)]
    df = spark.createDataFrame(people, "id long, person_name string")
    rows = [tuple(r) for r in N.similar_people_by_name(df, 2).collect()]
    assert len(rows) == len(set(rows)) == (120 - 5) + 3
    first = {i: i for i, name in people if name is not None} | {b: a for a, b, k in rows if k == 0}
    links = {(a, b): k for a, b, k in rows if k}
    got = {(a, b, links.get(tuple(sorted((first[a], first[b]))), 0)) for a, b in itertools.combinations(sorted(first), 2) if first[a] == first[b] or tuple(sorted((first[a], first[b]))) in links}
    assert got == {tuple(r) for r in N.similar_people(df, 2).collect()}


def test_all_people_are_paired(spark, tmp_path):
    """The query gives every two people whose names are near, also where several bear a name."""
    people = [(i, f"Supplier#{i % 40 * 37:09d}", 1.0, i % 25) for i in range(120)]
    spark.createDataFrame(people, "s_suppkey long, s_name string, s_acctbal double, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    special = {0: "_NO_FACE_ASSIGNED_", 1: ".ignore", 2: ".realignore", 3: ".another_ignore"}
    names = {i: special.get(i, name).lower() for i, name, *_ in people}
    want = sorted((a, b, k) for a, b in itertools.combinations(sorted(names), 2) if (k := distance(names[a], names[b])) <= 2)
    assert sum(k == 0 for *_, k in want) > 100 and sorted(map(tuple, training.name_distance(spark, str(tmp_path)).collect())) == want


def test_crowded_names_meet_little_oftener_than_they_are_near(spark):
    """Numbered names share all but some digits: texts that are a few deletions apart are no reason to meet."""
    names = [f"supplier#{i:09d}" for i in range(600)]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("length", F.char_length("name"))
    key = ["length", "k", "piece", "left"]
    met = N.left_over(N.filed(df, 2), 2).join(N.left_over(N.looked_up(df, 2), 2).select(*key, F.col("name").alias("other")), key).where("name < other")
    assert met.where(F.levenshtein("name", "other") > 2).count() == 0
    found = N.similar_names(df, 2).count()
    assert found == len(near(names, 2)) and met.count() < 6 * found


@pytest.mark.parametrize("groups", [M.BROADCAST_GROUPS, 0])
def test_medians(spark, monkeypatch, groups):
    monkeypatch.setattr(M, "BROADCAST_GROUPS", groups)
    monkeypatch.setattr(M, "RANGES", 4)
    rng = np.random.default_rng(7)
    values = {1: rng.normal(size=301) * 1e9, 2: rng.integers(0, 5, 200), 3: [5.0], 4: [1.0, 2.0], 5: [7.0] * 50, 6: [*[0.0] * 99, 1e300, -1e300, 1e-300], 7: np.exp(rng.normal(size=400) * 40), 8: [-1.7e308, 1.7e308, 0.0, 3.0]}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(9, None), (9, float("nan")), (None, 4.0), (4, None)]
    rng.shuffle(rows)
    got = {r.k: (r["median"], r.n) for r in M.medians(spark.createDataFrame([(None if k is None else int(k), None if v is None else float(v)) for k, v in rows], "k long, v double"), "k", "v").collect()}
    assert got == {k: (pytest.approx(float(np.median(vs)), rel=1e-15), len(vs)) for k, vs in values.items()}
    assert M.medians(spark.createDataFrame([], "k long, v double"), "k", "v").collect() == []


def test_a_directory_with_most_images(spark):
    """No task buffers a directory: the plan holds no percentile, and nothing is grouped but by partial counts."""
    images = spark.range(4000).select(F.when(F.col("id") % 10 != 0, 1).otherwise(F.col("id")).alias("directory_id"), F.timestamp_seconds(F.col("id") * F.col("id") % 100_003 * 60).cast("timestamp_ntz").alias("date_taken"), (F.col("id") % 7 != 0).alias("date_taken_valid"))
    out = C.robust_dates(images, now=5.0)
    plan = out._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "collect_list" not in plan
    sec = np.array([i * i % 100_003 * 60 for i in range(4000) if i % 10 and i % 7], float)
    apart = np.abs(sec - np.median(sec))
    kept = sec[apart / np.median(apart) < 2]
    row = out.where("directory_id = 1").first()
    assert (row.mean_datesec, row.first_datesec, row.n_used) == (pytest.approx(kept.mean()), kept.min(), len(kept))
    assert out.where("n_used = 0 and mean_datesec = 5.0").count() == sum(i % 10 == 0 and i % 7 == 0 for i in range(4000))


@pytest.mark.parametrize("held", [0, 50])
def test_medians_of_large_and_small_groups(spark, monkeypatch, held):
    """Groups of more than HELD values are counted, others sorted; both at once, with ends beyond each other's doubles."""
    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "RANGES", 4)
    rng = np.random.default_rng(8)
    values = {1: rng.normal(size=301) * 1e9, 2: rng.integers(0, 5, 200), 3: [5.0], 4: [1.0, 2.0], 5: [7.0] * 51, 6: [-1.7e308, 1.7e308, 0.0, 3.0] * 20, 7: rng.normal(size=50)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    got = {r.k: (r["median"], r.n) for r in M.medians(spark.createDataFrame(rows, "k long, v double"), "k", "v").collect()}
    assert got == {k: (pytest.approx(float(np.median(vs)), rel=1e-15), len(vs)) for k, vs in values.items()}


@pytest.mark.parametrize("held", [M.HELD, 20])
def test_many_groups_are_never_broadcast(spark, monkeypatch, held):
    """Groups beyond the bound are joined by sorting, however small their files are; large ones are dealt to several tasks."""
    monkeypatch.setattr(M, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(M, "HELD", held)
    groups = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") < 2, 900).otherwise(3).alias("n"), (F.col("id") * 2).alias("more"))
    rows = spark.range(2694).select(F.when(F.col("id") < 1800, F.col("id") % 2).otherwise(F.floor((F.col("id") - 1800) / 3) + 2).alias("k"), "id")
    out = M.attached(rows, groups, "k", 300)
    assert out.columns == ["k", "id", "more"]
    assert out.count() == 2694 and out.where("more = 2 * k").select("id").distinct().count() == 2694
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") <= 1
