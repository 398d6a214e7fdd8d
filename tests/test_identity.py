"""Suggestions against NumPy."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from pictorium.config import DEFAULTS
from pictorium.functions import scorers
from pictorium.operators import catalogue as C
from pictorium.operators import identity as I

PENDING, GALLERY = "id long, vec array<double>, rejected_ids array<bigint>", "id long, person_id long, vec array<double>"


def tables(spark, seed=1, n_pending=12, n_gallery=90, d=8):
    rng = np.random.default_rng(seed)
    pending = [(i, rng.normal(size=d).tolist(), [int(i % 4)] if i % 3 else None) for i in range(n_pending)]
    gallery = [(1000 + i, int(i % 6), rng.normal(size=d).tolist()) for i in range(n_gallery)]
    return pending, gallery, spark.createDataFrame(pending, PENDING), spark.createDataFrame(gallery, GALLERY)


def expected(pending, gallery, threshold, ignore):
    out = set()
    for i, v, rejected in pending:
        v, people = np.array(v), {}
        for _, p, g in gallery:
            if p not in (rejected or []):
                g = np.array(g)
                people.setdefault(p, []).append(v @ g / (np.linalg.norm(v) * np.linalg.norm(g)))
        ranked = sorted(((-max(s), p, np.percentile(s, 99)) for p, s in people.items()))
        good = [r for r in ranked if -r[0] > threshold][:5]
        if good:
            out |= {(i, k + 1, p, round(min(1, max(0, w)), 9)) for k, (_, p, w) in enumerate(good)}
        elif ignore in (rejected or []):
            out.add((i, 1, ranked[0][1], round(-ranked[0][0], 9)))
        else:
            out.add((i, 1, ignore, round(1 + ranked[0][0], 9)))
    return out


def test_suggestions(spark):
    pending, gallery, p, g = tables(spark)
    for threshold in (0.3, 0.8):
        got = {(r.face_id, r.rank, r.person_id, round(r.weight, 9)) for r in I.suggestions(p, g, 2, replace(DEFAULTS, similarity_threshold=threshold)).collect()}
        assert got == expected(pending, gallery, threshold, 2)


def test_blocks_give_the_same_percentiles(spark):
    """Many small blocks, broadcast or joined, against NumPy: by person, and over all people but the rejected ones."""
    pending, gallery, p, g = tables(spark, n_pending=30, n_gallery=400)
    shares = (0.0, 0.05, 0.3, 0.5, 0.99, 1.0)
    want = {}
    for i, v, rejected in pending:
        for person in (None, *range(6)):
            s = [np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) for _, q, w in gallery if q not in (rejected or []) and person in (None, q)]
            if s:
                want[i, person] = (len(s), *[round(float(x), 9) for x in np.percentile(s, [100 * x for x in shares])])
    kept = I.FACE_BLOCK, I.GALLERY_BLOCK, I.BROADCAST_NUMBERS
    for I.FACE_BLOCK, I.GALLERY_BLOCK, I.BROADCAST_NUMBERS in (kept, (7, 20, 0), (4, 900, 10**9)):
        got = {(r.face_id, r.person_id): (r.n, *[round(x, 9) for x in r.p]) for r in I.tails(p, g, shares).collect()}
        got |= {(r.face_id, None): (r.n, *[round(x, 9) for x in r.p]) for r in I.tails(p, g, shares, per_person=False).collect()}
        assert got == want
    I.FACE_BLOCK, I.GALLERY_BLOCK, I.BROADCAST_NUMBERS = kept


def test_another_measure(spark):
    """A comparing network's forward pass as the measure, and a linear classifier's shares."""
    rng = np.random.default_rng(4)
    pending, gallery, p, g = tables(spark, n_pending=5, n_gallery=30)
    w1, b1, w2, b2 = rng.normal(size=(8, 4)), rng.normal(size=4), rng.normal(size=(4, 1)), rng.normal(size=1)
    plain = lambda a, b: float(1 / (1 + np.exp(-(np.maximum(np.abs(np.array(a) - b) @ w1 + b1, 0) @ w2 + b2)[0])))
    rows = I.by_person(p, g, measure=scorers.compared([(w1, b1), (w2, b2)])).collect()
    known = {i: (v, r or []) for i, v, r in pending}
    assert rows
    for r in rows:
        s = [plain(known[r.face_id][0], w) for _, q, w in gallery if q == r.person_id]
        assert r.person_id not in known[r.face_id][1] and abs(r.sim_max - max(s)) < 1e-9 and abs(r.sim_p - np.percentile(s, 99)) < 1e-9
    shares = scorers.class_shares(rng.normal(size=(6, 3)), rng.normal(size=(3, 4)), rng.normal(size=4))
    assert shares.shape == (6, 4) and np.allclose(shares.sum(axis=1), 1)


def test_unusable_vectors(spark):
    p = spark.createDataFrame([(1, None, None), (2, [-999.0, -999.0], None), (3, [1.0, 0.0], None), (4, [0.0, 0.0], None), (5, [1.0, 0.0, 0.0], None)], PENDING)
    g = spark.createDataFrame([(9, 5, [1.0, 0.0])], GALLERY)
    assert [(r.face_id, r.sim_max) for r in I.by_person(p, g).collect()] == [(3, 1.0)]
    assert I.by_person(p, g.limit(0)).collect() == []


def test_nearest_distances(spark):
    _, gallery, _, g = tables(spark, n_gallery=120)
    kept = I.FACE_BLOCK, I.GALLERY_BLOCK
    for I.FACE_BLOCK, I.GALLERY_BLOCK in (kept, (9, 11)):
        got = {}
        for r in I.nearest_distances(g, g, 3).collect():
            got.setdefault((r.face_id, r.person_id), []).append((round(r.d, 9), r.gallery_id))
        for i, _, v in gallery:
            for person in range(6):
                want = sorted((round(float(np.linalg.norm(np.array(v) - w)), 9), j) for j, q, w in gallery if q == person and j != i)[:3]
                assert sorted(got[i, person]) == want
    I.FACE_BLOCK, I.GALLERY_BLOCK = kept


def test_pending_and_candidates(spark):
    faces = spark.createDataFrame([(1, 0, [1.0], []), (2, 0, [1.0], [(5, 0.5)]), (3, 4, [1.0], []), (4, 0, [-999.0], []), (5, 0, None, [])], "id long, declared_person_id long, vec array<double>, candidates array<struct<person_id:bigint,weight:double>>")
    assert [r.id for r in I.pending_faces(faces, 0).collect()] == [1]
    rows = spark.createDataFrame([(7, 2, 5, 0.25), (7, 1, 6, 0.5), (8, 1, 3, 1.0)], "face_id long, rank int, person_id long, weight double")
    got = {r.id: [tuple(c) for c in r.candidates] for r in I.as_candidates(rows).collect()}
    assert got == {7: [(6, 0.5), (5, 0.25)], 8: [(3, 1.0)]}


def test_more_than_the_least_number(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, ".ignore")], "id long, person_name string")
    faces = spark.createDataFrame([(p,) for p, n in ((1, 11), (2, 10), (3, 30)) for _ in range(n)], "declared_person_id long")
    assert [r.id for r in I.eligible_people(people, faces).collect()] == [1]
    assert [(r.id, r.n_faces) for r in C.people_with_more(people, faces, 9).orderBy("id").collect()] == [(1, 11), (2, 10)]


def test_temporal_ties(spark):
    asked = spark.createDataFrame([(1, 10.0), (2, 0.0)], "face_id long, at double")
    known = spark.createDataFrame([(7, i, float(t)) for i, t in ((1, 10), (2, 10), (3, 9), (4, 11), (5, 9), (6, 30))], "person_id long, gallery_id long, at double")
    got = {f: [r.gallery_id for r in I.temporally_nearest(asked, known, 4).where(F.col("face_id") == f).orderBy("place").collect()] for f in (1, 2)}
    assert got == {1: [1, 2, 3, 4], 2: [3, 5, 1, 2]}


def test_null_person_counts_as_tagged(spark):
    images = spark.createDataFrame([], "is_processed boolean")
    people = spark.createDataFrame([(0, "_NO_FACE_ASSIGNED_"), (4, "Ann")], "id long, person_name string")
    faces = spark.createDataFrame([(None, True), (0, False), (4, False)], "declared_person_id long, validated boolean")
    row = C.server_stats(images, faces, people).first()
    assert (row.num_tagged, row.verified_percent, row.processed_percent, row.num_unassigned) == (2, "50.00%", None, 1)


def test_a_face_is_not_its_own_neighbour(spark):
    rng = np.random.default_rng(6)
    known = [(int(rng.integers(0, 3)), i, float(rng.integers(0, 40))) for i in range(120)]
    asked = [(i, i, t) for _, i, t in known[::7]]
    rows = I.temporally_nearest(spark.createDataFrame(asked, "face_id long, own_id long, at double"), spark.createDataFrame(known, "person_id long, gallery_id long, at double").repartition(5), 4).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.place):
        got.setdefault((r.face_id, r.person_id), []).append(r.gallery_id)
    for i, _, t in asked:
        for p in range(3):
            assert got[i, p] == [j for _, j in sorted((abs(u - t), j) for q, j, u in known if q == p and j != i)[:4]]
