"""Sums kept up by differences against whole counts, and messages that come late, twice or never."""

import random

import pytest
from pyspark.sql import functions as F

from pictorium.operators import catalogue as C
from pictorium.operators import curation as D
from pictorium.schema import CANDIDATES
from pictorium.streaming import curation as stream
from pictorium.streaming import ordering as O
from pictorium.streaming import upkeep as U

FACE = f"id long, declared_person_id long, validated boolean, written_to_photo_metadata boolean, candidates {CANDIDATES}, rejected_ids array<bigint>"
OPS = "seq long, face_id_list array<bigint>, operation string, current_person_id long"
MARKS = D.Marks(0, 1, 2)


def faces(spark, n=60):
    return spark.createDataFrame([(i, None if i % 11 == 0 else i % 4, i % 2 == 0, False, [((i + k) % 6, 0.5) for k in range(i % 4)], None) for i in range(n)], FACE)


def test_counts_follow_the_faces(spark, tmp_path):
    """After each batch the sums are those of a new count, also of a batch that runs again, and over folds."""
    people = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "id long, person_name string")
    table = stream.FaceTable(spark, str(tmp_path / "faces"), 8)
    table.start(faces(spark))
    view = U.SumView(spark, str(tmp_path / "counts"), "person_id", U.PERSON_MEASURES, fold=2)
    view.start(U.person_contributions(faces(spark)))
    step, rng = U.counted(table, view, MARKS), random.Random(1)
    kinds = ["close_unassigned", "close_ignored", "close_assigned", "confirm_proposed", "verify_face"]
    for n in range(5):
        rows = [(10 * n + k, rng.sample(range(70), 3), rng.choice(kinds), rng.randrange(6)) for k in range(4)] if n != 3 else []
        batch = spark.createDataFrame(rows, OPS)
        for _ in range(1 + (n % 2)):
            step(batch, n)
        got = {tuple(r) for r in U.with_counts(people, view.read(n)).collect()}
        assert got == {tuple(r) for r in C.counters(people, table.read(n)).select("id", "person_name", *U.PERSON_MEASURES).collect()}
    held = {p.name for p in (tmp_path / "counts").iterdir()}
    assert "base3" in held and not held & {"base-1", "change0", "change1"}
    # another process finds what this one left
    assert U.SumView(spark, str(tmp_path / "counts"), "person_id", U.PERSON_MEASURES, fold=2).read(4).count() == view.read(4).count()


def test_a_batch_reads_its_buckets_alone(spark, tmp_path, monkeypatch):
    table = stream.FaceTable(spark, str(tmp_path / "faces"), 16)
    table.start(faces(spark))
    view = U.SumView(spark, str(tmp_path / "counts"), "person_id", U.PERSON_MEASURES)
    view.start(U.person_contributions(faces(spark)))
    read = []
    kept = table.rows
    monkeypatch.setattr(table, "rows", lambda versions: read.append(set(versions)) or kept(versions))
    U.counted(table, view, MARKS)(spark.createDataFrame([(1, [5], "confirm_proposed", 3)], OPS), 0)
    assert read and all(len(r) == 1 for r in read)


def streamed(spark, folder, messages, patience_ms, arrivals):
    """(batch, row) of all messages with their fates; messages: (arrival, face, nth, operation, person)."""
    df = spark.createDataFrame(messages, "arrival long, face_id long, nth long, operation string, person long")
    for n in range(arrivals):
        df.where(F.col("arrival") == n).drop("arrival").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(O.MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = []
    query = O.with_rocks(spark, lambda: stream.started(O.in_turn(source, patience_ms), lambda batch, n: out.extend((n, tuple(r)) for r in batch.collect()), f"{folder}/checkpoint"), ends=True)
    assert query.awaitTermination(120), "the query doesn't end"
    assert query.exception() is None
    return out


def test_any_order_comes_out_in_turn(spark, tmp_path):
    rng = random.Random(3)
    sent = [(face, nth, "verify_face", face * 100 + nth) for face in range(8) for nth in range(1, 7)]
    messages = [(rng.randrange(3), *m) for m in sent] + [(2, *sent[0]), (2, *sent[7]), (1, 3, None, "verify_face", 1), (1, None, 4, "verify_face", 1), (1, 3, 0, "verify_face", 1)]
    out = streamed(spark, str(tmp_path), messages, 10**9, 3)
    assert len(out) == len(messages)
    for face in range(8):
        mine = [(n, r[1]) for n, r in out if r[0] == face and r[4] == O.DUE]
        assert [nth for _, nth in mine] == [1, 2, 3, 4, 5, 6] and sorted(mine) == mine
    fates = sorted((r[0] is None, r[4]) for _, r in out if r[4] != O.DUE)
    assert fates == [(False, O.REPEATED), (False, O.REPEATED), (False, O.UNNUMBERED), (False, O.UNNUMBERED), (True, O.UNNUMBERED)]


def test_a_gap_is_given_up_in_time(spark, tmp_path):
    """2 is missing: after the timer 3 and 4 go on, 2 comes late and once more, 5 follows in turn."""
    rows = [(0, 1, 1, "a", 1), (0, 1, 4, "d", 4), (0, 1, 3, "c", 3), (1, 2, 1, "x", 9), (2, 1, 2, "b", 2), (2, 1, 5, "e", 5), (3, 1, 2, "b", 2), (3, 1, 7, "g", 7)]
    out = streamed(spark, str(tmp_path), rows, 1, 4)
    mine = [(r[1], r[4]) for _, r in out if r[0] == 1]
    assert mine[:3] == [(1, O.DUE), (3, O.DUE), (4, O.DUE)] and sorted(mine[3:5]) == [(2, O.LATE), (5, O.DUE)] and mine[5:6] == [(2, O.REPEATED)]
    assert (2, 1, "x", 9, O.DUE) in [r for _, r in out]


def test_faces_share_their_state(spark, tmp_path):
    """Many faces are few states; integers beyond a double's stay whole beside nulls; a share's gaps end each in its time."""
    big = 2**53 + 1
    spark.createDataFrame([(big + 2 * face, nth, "verify_face", None if face % 3 else big + 2 * face) for face in range(300) for nth in (2, 1)] + [(None, big, "a", big), (big, None, "b", 1)], O.MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/in")
    source, out = spark.readStream.schema(O.MESSAGES).parquet(f"{tmp_path}/in"), []
    query = O.with_rocks(spark, lambda: stream.started(O.in_turn(source, 10**9, 8), lambda batch, n: out.extend(map(tuple, batch.collect())), f"{tmp_path}/checkpoint"), ends=True)
    assert query.awaitTermination(120) and query.exception() is None
    due = [r for r in out if r[4] == O.DUE]
    assert sorted(due, key=lambda r: r[:2]) == [(big + 2 * face, nth, "verify_face", None if face % 3 else big + 2 * face, O.DUE) for face in range(300) for nth in (1, 2)]
    assert sorted(set(out) - set(due), key=str) == sorted([(None, big, "a", big, O.UNNUMBERED), (big, None, "b", 1, O.UNNUMBERED)], key=str)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 8


def test_an_arrival_of_many_files_is_a_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "ROWS_A_FILE", 20, raising=False)
    rows = spark.range(300).select(F.col("id").alias("seq"), F.array("id").alias("face_id_list"))
    source, out = stream.arrived(rows, f"{tmp_path}/in", "seq", 3), []
    assert len(list((tmp_path / "in").rglob("*.parquet"))) == 15
    stream.started(source, lambda batch, n: out.append(sorted(r.seq for r in batch.collect())), f"{tmp_path}/checkpoint").awaitTermination()
    assert len(out) == 3 and sum(out, []) == list(range(300))


def test_late_messages_are_set_aside(spark, tmp_path):
    table = stream.FaceTable(spark, str(tmp_path / "faces"), 4)
    table.start(faces(spark, 4))
    step = O.applied_in_turn(table, MARKS, str(tmp_path / "aside"))
    rows = [(3, 1, "confirm_proposed", 5, O.DUE), (3, 2, "verify_face", None, O.DUE), (2, 1, "confirm_proposed", 5, O.LATE)]
    for _ in range(2):
        step(spark.createDataFrame(rows, O.FATED), 0)
    got = {r.id: (r.declared_person_id, r.validated) for r in table.read(0).collect()}
    assert got[3] == (5, True) and got[2] == (2, True)
    assert [r.face_id for r in spark.read.parquet(str(tmp_path / "aside")).collect()] == [2]


def test_numbers_of_the_sender(spark):
    ops = spark.createDataFrame([(5, [1, 2, 1], "a", 1), (3, [2], "b", None), (9, [], "c", 1), (8, None, "c", 1)], OPS)
    assert {(r.face_id, r.nth, r.operation) for r in O.numbered_messages(ops).collect()} == {(1, 1, "a"), (2, 1, "b"), (2, 2, "a")}


@pytest.mark.parametrize("number,base", [(-1, -1), (0, -1), (2, -1), (3, 3), (6, 3), (7, 7)])
def test_which_base(spark, number, base):
    assert U.SumView(spark, "", "k", ["n"], fold=4).base(number) == base


def test_a_batch_writes_the_changed_faces_alone(spark, tmp_path, monkeypatch):
    """Versions hold what changed, and after some of them the whole bucket again; a batch that runs again changes nothing."""
    monkeypatch.setattr(stream, "KEPT", 3)
    table = stream.FaceTable(spark, str(tmp_path / "faces"), 2)
    table.start(faces(spark))
    step = table.apply(MARKS)
    for n in range(6):
        batch = spark.createDataFrame([(n, [7, 7 + n, 500], "confirm_proposed", n)], OPS)
        for _ in range(1 + n % 2):
            step(batch, n)
        written = spark.read.parquet(str(tmp_path / "faces" / f"v{n}"))
        of_seven = table.listed(n)[written.where("id = 7").first()["bucket"]]
        if of_seven != [n]:
            assert len(of_seven) <= 3 and {r.id for r in written.where(f"bucket = {written.where('id = 7').first()['bucket']}").collect()} <= {7, 7 + n}
        got = {r.id: r.declared_person_id for r in table.read(n).collect()}
        assert len(got) == 60 and got[7] == n and all(got[7 + k] == k for k in range(1, n + 1))
    assert any(held[0] > -1 for held in table.listed(5).values())
