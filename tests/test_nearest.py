"""The pruned search against all pairs, and how much of them it leaves out."""

from dataclasses import replace

import numpy as np
import pytest

from pictorium.config import DEFAULTS
from pictorium.operators import identity as I
from pictorium.operators import nearest as N
from tests.test_identity import expected

ASKED, KNOWN = "id long, vec array<double>, rejected_ids array<bigint>", "id long, person_id long, vec array<double>"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(N, "FACE_BLOCK", 10)
    monkeypatch.setattr(N, "GALLERY_BLOCK", 25)


def clustered(rng, n, d=16, centres=20, spread=0.02, seed=5):
    middle = np.random.default_rng(seed).normal(size=(centres, d))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    home = rng.integers(0, centres, n)
    return home, middle[home] + spread * rng.normal(size=(n, d))


def lists(found):
    return {(r.face_id, r.person_id): [(round(x.v, 9), x.id) for x in r.near] for r in found.rows.collect()}


def all_pairs(asked, known, keep, *, cosine, others_only, per_person=True):
    out = {}
    for i, v, rejected in asked:
        for j, p, w in known:
            if p in (rejected or ()) or others_only and i == j:
                continue
            a, b = np.array(v), np.array(w)
            score = -(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) if cosine else np.linalg.norm(a - b)
            out.setdefault((i, p if per_person else 0), []).append((round(float(score), 9), j))
    return {k: sorted(x)[: keep(len(x)) if callable(keep) else keep] for k, x in out.items()}


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("shape", ["clustered", "random"])
def test_nearest_of_each_person(spark, small_blocks, monkeypatch, cosine, shape):
    rng = np.random.default_rng(3)
    n_asked, n = 60, 500
    if shape == "clustered":
        _, asked_vectors = clustered(rng, n_asked)
        home, vectors = clustered(rng, n)
        owner = home // 2
    else:
        asked_vectors, vectors, owner = rng.normal(size=(n_asked, 16)), rng.normal(size=(n, 16)), rng.integers(0, 7, n)
    asked = [(i, v.tolist(), [int(i % 5), 999] if i % 2 else None) for i, v in enumerate(asked_vectors)]
    known = [(1000 + i, int(p), v.tolist()) for i, (p, v) in enumerate(zip(owner, vectors, strict=True))]
    for numbers in (N.BROADCAST_NUMBERS, 0):
        monkeypatch.setattr(N, "BROADCAST_NUMBERS", numbers)
        found = N.nearest(spark.createDataFrame(asked, ASKED), spark.createDataFrame(known, KNOWN), 3, cosine=cosine)
        assert lists(found) == all_pairs(asked, known, 3, cosine=cosine, others_only=False)
        assert 0 < found.met <= found.pairs


@pytest.mark.parametrize("cosine", [True, False])
def test_few_blocks_meet(spark, small_blocks, cosine):
    """Nearest of all vectors among clustered ones: at most 30 per cent of the pairs of blocks are multiplied."""
    rng = np.random.default_rng(4)
    _, vectors = clustered(rng, 1500, centres=40)
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    known = [(i, 0, v) for i, v, _ in rows]
    found = N.nearest(spark.createDataFrame(rows, ASKED), spark.createDataFrame(known, KNOWN), 5, per_person=False, cosine=cosine, others_only=True)
    got = lists(found)
    share = found.met / found.pairs
    assert share <= 0.3 and found.pairs > 1000, share
    some = [r for r in rows if r[0] % 40 == 0]
    want = all_pairs(some, known, 5, cosine=cosine, others_only=True, per_person=False)
    assert len(got) == len(rows) and {k: got[k] for k in want} == want


def test_suggestions_skip_blocks(spark, small_blocks):
    """Maximum and 99th percentile of large persons, one of whom holds most of the vectors."""
    rng = np.random.default_rng(9)
    home, vectors = clustered(rng, 1200, centres=12)
    owner = np.where(home < 6, 0, home)
    known = [(10_000 + i, int(p), v.tolist()) for i, (p, v) in enumerate(zip(owner, vectors, strict=True))]
    _, asked_vectors = clustered(rng, 80, centres=12)
    asked = [(i, v.tolist(), [int(i % 12)] if i % 3 == 0 else None) for i, v in enumerate(asked_vectors)]
    p, g = spark.createDataFrame(asked, ASKED), spark.createDataFrame(known, KNOWN)
    assert (found := N.nearest(p, g, (0.99,), cosine=True)).met < 0.7 * found.pairs
    rows = I.by_person(p, g).collect()
    scale = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in asked}
    for r in rows:
        s = [float(scale[r.face_id] @ np.array(w) / np.linalg.norm(w)) for _, q, w in known if q == r.person_id]
        assert abs(r.sim_max - max(s)) < 1e-9 and abs(r.sim_p - np.percentile(s, 99)) < 1e-9
    want = {(i, int(q)) for i, _, rejected in asked for q in set(owner.tolist()) - set(rejected or ())}
    assert {(r.face_id, r.person_id) for r in rows} == want
    # suggestions need less: who is like enough, and else the nearest; three searches together meet few of the pairs
    for threshold in (0.9, 0.9999):
        settings = replace(DEFAULTS, similarity_threshold=threshold)
        got = I.suggested(p, g, 7, settings)
        assert got.met <= (0.5 if threshold < 0.99 else 0.7) * got.pairs
        assert {(r.face_id, r.rank, r.person_id, round(r.weight, 9)) for r in got.rows.collect()} == expected(asked, known, threshold, 7)


def test_equal_and_odd_vectors(spark, small_blocks):
    """Many equal vectors are told apart by their ids; what can't be measured takes no part."""
    known = [(i, 1, [1.0, 2.0]) for i in range(80)] + [(100, 2, None), (101, 2, [-999.0, -999.0]), (102, 2, [float("nan"), 1.0]), (103, 2, [None, 1.0]), (104, None, [1.0, 2.0]), (105, 3, [0.0, 0.0]), (106, 4, [1.0, 2.0, 3.0])]
    asked = [(7, [1.0, 2.0], None), (7, [1.0, 2.0], None), (8, [float("inf"), 0.0], None), (9, [1.0, 1.0, 1.0], None), (10, [], None), (11, [1.0], None)]
    a, k = spark.createDataFrame(asked, ASKED), spark.createDataFrame(known, KNOWN)
    got = lists(N.nearest(a, k, 4, others_only=True))
    assert {i for i, _ in got} == {7, 9}
    assert got[7, 1] == [(0.0, i) for i in (0, 0, 1, 1)] or got[7, 1] == [(0.0, i) for i in range(4)]
    assert [x for _, x in got[7, 3]][:1] == [105] and [x for _, x in got[9, 4]] == [106]
    assert {p for _, p in lists(N.nearest(a, k, 4, cosine=True))} == {1, 4}
    assert lists(N.nearest(a, k.limit(0), 4)) == {} and lists(N.nearest(a.limit(0), k, 4)) == {}


def test_each_asked_row_has_its_own_list(spark, small_blocks):
    """Rows asked twice under one id aren't merged: each has the whole list."""
    known = [(i, 1, [float(i), 0.0]) for i in range(60)]
    found = N.nearest(spark.createDataFrame([(7, [1.0, 2.0], None)] * 2, ASKED), spark.createDataFrame(known, KNOWN), 3)
    assert [[x.id for x in r.near] for r in found.rows.collect()] == [[1, 0, 2]] * 2
