"""A gallery kept between runs, deep pages, sets and needles by their rarest part, boxes in cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.operators import containment as Q
from pictorium.operators import grid as G
from pictorium.operators import identity as I
from pictorium.operators import matching as M
from pictorium.operators import nearest as N
from pictorium.operators.gallery import Gallery
from pictorium.operators.pages import Paged
from tests.test_nearest import ASKED, KNOWN, clustered


def test_gallery_packs_what_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "GALLERY_BLOCK", 20)
    rng = np.random.default_rng(5)
    home, vectors = clustered(rng, 600, centres=30)
    first = [(i, int(p), v.tolist()) for i, (p, v) in enumerate(zip(home, vectors, strict=True))]
    asked = spark.createDataFrame([(10_000 + i, v.tolist(), None) for i, v in enumerate(clustered(rng, 25, centres=30)[1])], ASKED)
    gallery = Gallery(spark, str(tmp_path / "g"), 16)
    built = gallery.build(spark.createDataFrame(first, KNOWN))
    assert built.people == 30 and built.repacked == built.blocks > 20
    assert gallery.refresh(spark.createDataFrame(first, KNOWN)) == (0, 0, built.blocks)
    # of three people one loses faces, one goes, one is new; one face of another length and one that can't be used come in
    second = [(i, p, v) for i, p, v in first if p not in (3, 4) or p == 3 and i % 2] + [(5000 + i, 77, clustered(rng, 1, centres=30)[1][0].tolist()) for i in range(4)] + [(6000, 8, [1.0]), (6001, 8, None)]
    now = spark.createDataFrame(second, KNOWN)
    done = gallery.refresh(now)
    assert done.people == 3 and 0 < done.repacked <= 12 and done.repacked < built.blocks / 2
    rows = lambda g: {(r.face_id, r.person_id, round(r.sim_max, 9), round(r.sim_p, 9)) for r in I.by_person(asked, g).collect()}
    assert rows(gallery.read()) == rows(now)
    held = gallery.read().table.select(F.inline("rows")).select("person_id", "id").collect()
    assert sorted(map(tuple, held)) == sorted((p, i) for i, p, v in second if v and len(v) == 16)
    # a refresh that failed before its index was written is done again
    (tmp_path / "g" / "index2").rename(tmp_path / "g" / "lost")
    assert gallery.generation() == 1 and gallery.refresh(now) == done and rows(gallery.read()) == rows(now)
    # twice as many vectors: built again
    again = gallery.refresh(spark.createDataFrame(second + [(20_000 + i, p, v) for i, p, v in first] + [(30_000 + i, p, v) for i, p, v in first], KNOWN))
    assert again.repacked == again.blocks


def test_pages_read_their_ranges(spark):
    rows = spark.range(20_000).select(F.format_string("n%05d", (F.col("id") * 7919 % 20_000 / 3).cast("int")).alias("name"), "id").repartition(7)
    paged = Paged(rows, ("name", "id"), 500)
    want = sorted(tuple(r) for r in rows.collect())
    assert paged.total == 20_000 and sum(r.n for r in paged.ranges) == 20_000 and len(paged.ranges) > 20
    for offset, size in ((0, 10), (10_000, 50), (19_990, 50), (499, 1200), (30_000, 5)):
        got = paged.at(offset, size)
        assert [tuple(r) for r in got.collect()] == want[offset : offset + size]
        read = paged._of([r for r in paged.ranges if r.before < offset + size and r.before + r.n > offset])
        assert read.select(F.input_file_name()).distinct().count() <= (2 if size < 1000 else 5)
        # ranges are folders: others' files aren't opened
        plan = got._jdf.queryExecution().toString()
        assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0] or offset == 30_000
    page = paged.page(400, 50).collect()
    assert [(r.name, r.id) for r in page] == want[19_950:] and (page[0].total, page[0].has_previous, page[0].has_next) == (20_000, True, False)
    for k in (0, 777, 12_345, 19_995, 19_999):
        assert [tuple(r) for r in paged.after(want[k], 30).collect()] == want[k + 1 : k + 31]
    assert [tuple(r) for r in paged.after(("", -1), 5).collect()] == want[:5] and paged.after(("z", 0), 5).collect() == []
    nothing = Paged(rows.limit(0), ("name", "id"))
    assert nothing.page(1, 5).collect() == [] and nothing.after(("a", 1), 5).collect() == []


def test_a_thousand_sets(spark):
    rng = random.Random(4)
    held = [(image, min(int(rng.expovariate(0.15)), 60)) for image in range(800) for _ in range(rng.randrange(6))] + [(1, None), (None, 2), (1, 1), (1, 1)]
    sets = [(k, min(int(rng.expovariate(0.1)), 70)) for k in range(1000) for _ in range(rng.randrange(1, 4))] + [(5, None), (None, 3)]
    got = Q.holding_all(spark.createDataFrame(sets, "set_id long, person_id long"), spark.createDataFrame(held, "image_id long, person_id long"))
    people = {}
    for image, p in held:
        if image is not None and p is not None:
            people.setdefault(image, set()).add(p)
    wanted = {}
    for k, p in sets:
        if k is not None and p is not None:
            wanted.setdefault(k, set()).add(p)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(k, image) for k, w in wanted.items() for image, have in people.items() if w <= have}


def test_needles(spark):
    rng = random.Random(6)
    texts = [(i, "/photos/" + "".join(rng.choices("abcÀé", k=rng.randrange(12))) + ".JPG") for i in range(400)] + [(900, None), (901, ""), (902, "ab"), (903, "a")]
    needles = ["photos", "PHOTOS/a", "abc", "cab.jpg", "éa", "É", "zzz", "", "abcabcabc", "a", ".jpg", None, "photosx", "bcÀ", "BCà"]
    df = spark.createDataFrame(texts, "id long, text string")
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    for any_case in (True, False):
        fold = str.lower if any_case else str
        index = Q.Substrings(df, any_case=any_case)
        want = {(n, i) for n in needles if n is not None for i, t in texts if t is not None and fold(n) in fold(t)}
        rows = [tuple(r) for r in index.found(asked).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    # few rows are verified: the rarest trigrams lead to them
    index = Q.Substrings(df)
    rare = spark.createDataFrame([("/photos/abca",), ("cab.jpg",)], "needle string")
    assert index.candidates(rare).count() <= 2 * index.found(rare).count() + 8 < 0.1 * 2 * len(texts)


def test_sets_of_the_same_people(spark):
    """They are looked for once; sets of one to five people, each asked by many ids."""
    rng = random.Random(16)
    held = {(rng.randrange(150), rng.randrange(8)) for _ in range(700)}
    wanted = {i: rng.sample(range(9), 1 + i % 5) for i in range(40)}
    sets = [(i + 1000 * k, p) for i, people in wanted.items() for k in range(10) for p in reversed(people)]
    images = {i: {p for image, p in held if image == i} for i in range(150)}
    df = spark.createDataFrame(sets, "set_id long, person_id long")
    rows = [tuple(r) for r in Q.holding_all(df, spark.createDataFrame(sorted(held), "image_id long, person_id long")).collect()]
    assert sorted(rows) == sorted((i + 1000 * k, image) for i, people in wanted.items() for k in range(10) for image, those in images.items() if set(people) <= those)
    assert Q.kinds_of(df)[1].count() == len({frozenset(p) for p in wanted.values()})


def test_needles_of_common_runs(spark):
    """Numbers between common ends: every run is in many texts and needles, but a text meets only what it holds."""
    texts = spark.range(3000).select("id", F.format_string("/photos/%d.jpg", "id").alias("text"))
    needles = spark.range(0, 3000, 2).select(F.format_string("/%d.J", "id").alias("needle"))
    index = Q.Substrings(texts)
    rows = [tuple(r) for r in index.found(needles).collect()]
    assert sorted(rows) == sorted((f"/{i}.J", i) for i in range(0, 3000, 2))
    # /1212.jpg holds all runs of /12.J, and is no candidate
    assert index.candidates(needles.select(F.lower("needle").alias("needle"))).count() == len(rows)


def test_many_needles_stay_off_the_driver(spark, monkeypatch):
    """Needles compress well as files: what is broadcast is bounded by what it takes in memory."""
    texts = spark.range(500).select("id", F.format_string("/photos/%d.jpg", "id").alias("text"))
    needles = spark.range(0, 1000, 2).select(F.format_string("/%d.J", "id").alias("needle")).union(spark.createDataFrame([("9",), ("",), (None,)], "needle string"))
    want = sorted({(f"/{i}.J", i) for i in range(0, 500, 2)} | {("9", i) for i in range(500) if "9" in str(i)} | {("", i) for i in range(500)})
    assert sorted(map(tuple, Q.Substrings(texts).found(needles).collect())) == want
    monkeypatch.setattr(Q, "BROADCAST_BYTES", 0, raising=False)
    found = Q.Substrings(texts).found(needles)
    assert sorted(map(tuple, found.collect())) == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def boxes(rng, n, extent, largest, image=1):
    out = []
    for i in range(n):
        l, t = rng.randrange(-20, extent), rng.randrange(-20, extent)  # noqa: E741
        out.append((image, i, l, t, l + rng.randrange(largest + 1), t + rng.randrange(largest + 1)))
    return out


def overlap(a, b):
    return max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)


KIND = "image_id long, id long, l int, t int, r int, b int"


def test_boxes_that_touch(spark):
    rng = random.Random(2)
    first = boxes(rng, 150, 700, 90) + boxes(rng, 20, 300, 700) + boxes(rng, 30, 400, 8, image=2)
    first = [(m, k, *rest) for k, (m, _, *rest) in enumerate(first)]
    second = [(m, 1000 + k, *rest) for k, (m, _, *rest) in enumerate(boxes(rng, 150, 700, 60) + boxes(rng, 3, 5, 2000) + boxes(rng, 30, 400, 40, image=2))]
    rows = [(r.image_id, r.a_id, r.c_id) for r in G.touching(spark.createDataFrame(first, KIND), spark.createDataFrame(second, KIND)).collect()]
    want = {(a[0], a[1], b[1]) for a in first for b in second if a[0] == b[0] and overlap(a, b) > 0}
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert G.touching(spark.createDataFrame([], KIND), spark.createDataFrame(second, KIND)).collect() == []


def test_suppression_in_rounds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(*b[:2], rng.choice((0.25, 0.5, 0.75, 1.0)), *b[2:]) for m in (1, 2) for b in boxes(rng, 90, 200, 60, image=m)] + [(3, i, 1.0 - i / 100, 10 * i, 0, 10 * i + 15, 10) for i in range(12)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, score double, l int, t int, r int, b int")
    whole = {tuple(r) for r in M.non_maximum(df, 0.15).collect()}
    monkeypatch.setattr(M, "MANY_BOXES", 20)
    assert {tuple(r) for r in M.non_maximum(df, 0.15).collect()} == whole and len(whole) > 20


def test_matches_of_many_boxes(spark, monkeypatch):
    rng = random.Random(9)
    known = boxes(rng, 80, 300, 50) + boxes(rng, 5, 300, 50, image=2)
    found = [(m, 500 + i, l + rng.randrange(-4, 5), t + rng.randrange(-4, 5), r, b) for m, i, l, t, r, b in known if rng.random() < 0.8]
    e, d = spark.createDataFrame(known, KIND), spark.createDataFrame(found, KIND).withColumnRenamed("id", "det_id")
    want = sorted(map(tuple, M.reconciled(e, d).collect()), key=repr)
    monkeypatch.setattr(M, "MANY_BOXES", 20)
    assert sorted(map(tuple, M.reconciled(e, d).collect()), key=repr) == want


def test_fifty_thousand_boxes_of_one_image(spark):
    n = 50_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("image_id"), "id", (F.col("id") * 7919 % 20_000).cast("int").alias("l"), (F.col("id") * 104_729 % 20_000).cast("int").alias("t"))
    df = df.select("*", (F.col("l") + 10 + F.col("id") % 60).cast("int").alias("r"), (F.col("t") + 10 + F.col("id") % 45).cast("int").alias("b"))
    pairs = G.touching(df, df).where("a_id < c_id")
    i = np.arange(n, dtype=np.int64)
    l, t = i * 7919 % 20_000, i * 104_729 % 20_000  # noqa: E741
    r, b = l + 10 + i % 60, t + 10 + i % 45
    asked = i[i % 100 == 0]
    want = {(int(a), int(c)) for a in asked for c in np.flatnonzero((np.minimum(r, r[a]) > np.maximum(l, l[a])) & (np.minimum(b, b[a]) > np.maximum(t, t[a]))) if c > a}
    assert {(x.a_id, x.c_id) for x in pairs.where("a_id % 100 = 0").collect()} == want and want


@pytest.mark.parametrize("shift", [0, -1000])
def test_negative_places(spark, shift):
    rows = [(1, 1, shift, shift, shift + 10, shift + 10), (1, 2, shift + 9, shift + 9, shift + 30, shift + 30), (1, 3, shift + 10, shift, shift + 20, shift + 9), (1, 4, shift + 5, shift + 5, shift + 5, shift + 9)]
    df = spark.createDataFrame(rows, KIND)
    assert {(r.a_id, r.c_id) for r in G.touching(df, df).where("a_id < c_id").collect()} == {(1, 2)}
