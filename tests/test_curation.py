"""State transitions against a face-by-face replay."""

from pictorium.operators import catalogue as C
from pictorium.operators import curation as D
from pictorium.plans import curation as plans
from pictorium.plans import stand_ins as S
from pictorium.schema import CANDIDATES

SF_DIR = "/root/testdata/sf0.001"
MARKS = D.Marks(0, 1, 2)
KIND = f"id long, declared_person_id long, validated boolean, written_to_photo_metadata boolean, candidates {CANDIDATES}, rejected_ids array<bigint>"


def faces(spark, *rows):
    return spark.createDataFrame([(i, d, v, False, [(p, 0.5) for p in c], None) for i, d, v, c in rows], KIND)


def ops(spark, *rows):
    return spark.createDataFrame(list(rows), "seq long, face_id_list array<bigint>, operation string, current_person_id long")


def shown(df):
    return {r.id: (r.declared_person_id, r.validated, [c.person_id for c in r.candidates], r.rejected_ids or []) for r in df.collect()}


def replay(state, messages):
    for _, ids, operation, person in sorted(messages):
        for i in ids:
            if i not in state:
                continue
            declared, validated, cands, rejected = state[i]
            to = None
            if operation == "close_unassigned":
                to = 1
            elif operation == "close_ignored" and (declared in (1, 2) or cands[:1] == [1]):
                to = 2
            elif operation == "confirm_proposed":
                to = person
            elif operation == "verify_face":
                validated = True
            elif operation == "close_assigned" and person in cands:
                cands, rejected = [c for c in cands if c != person], rejected + [person] * (person not in rejected)
            if to is not None:
                declared, validated, cands = to, False, []
            state[i] = declared, validated, cands, rejected
    return state


def test_each_operation(spark):
    start = faces(spark, (1, 0, True, [5, 6]), (2, 1, False, []), (3, 0, False, [1, 5]), (4, None, False, [5]))
    done = D.bulk_applied(start, ops(spark, (1, [1, 9], "close_unassigned", None), (2, [2, 3, 4], "close_ignored", None), (3, [4], "close_assigned", 5), (4, [4], "verify_face", None), (5, [1], "nonsense", 3)), MARKS)
    assert shown(done) == {1: (1, False, [], []), 2: (2, False, [], []), 3: (2, False, [], []), 4: (None, True, [], [5])}


def test_operations_depend_on_earlier_ones(spark):
    start = faces(spark, (1, 0, False, [5, 6, 7]))
    done = D.bulk_applied(start, ops(spark, (2, [1], "close_ignored", None), (1, [1], "close_unassigned", None), (3, [1], "verify_face", None)), MARKS)
    assert shown(done) == {1: (2, True, [], [])}


def test_as_a_replay(spark):
    start, messages = S.faces(spark, SF_DIR), plans.ops(spark, SF_DIR)
    want = replay(shown(start), [tuple(r) for r in messages.collect()])
    assert shown(D.bulk_applied(start, messages, plans.MARKS)) == want
    streamed = {r.id: r for r in plans.stream_bulk_ops(spark, SF_DIR).collect()}
    assert {i: (d, v, len(c), len(x)) for i, (d, v, c, x) in want.items()} == {i: (r.declared_person_id, r.validated, r.n_candidates, r.n_rejected) for i, r in streamed.items()}


def test_rejection_closes_gaps(spark):
    start = faces(spark, (1, 0, False, [5, 6, 7, 8, 9]))
    for person, left in ((5, [6, 7, 8, 9]), (7, [5, 6, 8, 9]), (9, [5, 6, 7, 8]), (4, [5, 6, 7, 8, 9])):
        got = shown(D.rejected(start, start["id"] == 1, person))[1]
        assert got[2] == left and got[3] == ([person] if person != 4 else [])


def test_counters_follow_the_faces(spark):
    people = spark.createDataFrame([(0, "a"), (5, "b"), (6, "c")], "id long, person_name string")
    start = faces(spark, (1, 5, True, [6]), (2, 5, False, [5, 6]), (3, None, False, []))
    got = {r.id: (r.num_faces, r.num_unverified_faces, r.num_possibilities, r.num_possibilities_any) for r in C.counters(people, start).collect()}
    assert got == {0: (0, 0, 0, 0), 5: (2, 1, 1, 1), 6: (0, 0, 1, 2)}


def test_the_unassigned_person_stays(spark):
    import pytest

    with pytest.raises(ValueError):
        D.person_deleted(None, None, 0, 0)
