"""Messages that arrive out of order: keyed state holds them back until those before them are there.

Each message to a face carries its number among that face's messages (`nth`, from 1). A face's state is the number that
is due and the messages that wait. What arrives in turn is handed on at once, with what waited for it, in order and
once. A gap starts a timer; when it has stood for `patience`, what waits is handed on without the missing ones, and these, should
they still come, are set aside as late. Messages that were handed on or wait already are set aside as repeated, those
without a face or a number as unnumbered. Nothing is lost: every message comes out once, with its fate.

State lives in RocksDB, by shares of the faces (a hash of the face's id): a face by itself would cost a handful of round trips
between Python and the store in every micro-batch. It holds the number that is due of each face, and what the gaps make wait.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pictorium.operators.curation import Marks
from pictorium.streaming.curation import FaceTable, Step

#: Messages to faces, as they travel.
MESSAGES = "face_id long, nth long, operation string, person long"
FATED = "face_id long, nth long, operation string, person long, fate string"
#: Shares of the faces, each with a state of its own: more for tables with far more faces that change at once.
SHARES = 1024
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
DUE, LATE, REPEATED, UNNUMBERED = "due", "late", "repeated", "unnumbered"


class Turn:
    """A face: the number that is due, what waits by number, the ranges given up, and when the gap before what waits is (0: no gap)."""

    __slots__ = ("due", "waiting", "given_up", "until")

    def __init__(self, due: int = 1, waiting: dict[int, tuple] | None = None, given_up: list[tuple[int, int]] | None = None, until: int = 0):
        self.due, self.waiting, self.given_up, self.until = due, waiting or {}, given_up or [], until

    def held(self) -> int | tuple:
        return (self.due, self.waiting, self.given_up, self.until) if self.waiting or self.given_up else self.due

    def fate(self, nth: int, message: tuple) -> str | None:
        """The fate of a message, None if it waits for its turn."""
        if nth >= self.due and nth not in self.waiting:
            self.waiting[nth] = message
            return None
        if nth in self.waiting or not any(a <= nth <= b for a, b in self.given_up):
            return REPEATED
        # it may come again: what came late once is repeated then
        self.given_up = [part for a, b in self.given_up for part in (((a, nth - 1), (nth + 1, b)) if a <= nth <= b else ((a, b),)) if part[0] <= part[1]]
        return LATE

    def run(self, face: int, out: list[tuple], late_at: int) -> None:
        """Hands on what is in turn. Another gap has a time of its own."""
        while self.due in self.waiting:
            out.append((face, self.due, *self.waiting.pop(self.due), DUE))
            self.due += 1
            self.until = 0
        self.until = (self.until or late_at) if self.waiting else 0


class InTurn(StatefulProcessor):
    """The messages of a share of the faces; see the module."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("messages", "held binary, timer long")

    def _held(self) -> tuple[dict[int, Turn], int]:
        if not self.state.exists():
            return {}, 0
        held, timer = self.state.get()
        return {face: Turn(*x) if isinstance(x, tuple) else Turn(x) for face, x in pickle.loads(held).items()}, timer

    def _kept(self, turns: dict[int, Turn], timer: int) -> None:
        """Sets the timer to the first gap that will have stood too long, and keeps the state."""
        first = min((t.until for t in turns.values() if t.until), default=0)
        if first != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)
        self.state.update((pickle.dumps({face: t.held() for face, t in turns.items()}), first))

    @staticmethod
    def _frame(out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            # objects, for integers with nulls among them would become floats
            yield pd.DataFrame(dict(zip(("face_id", "nth", "operation", "person", "fate"), (pd.Series(c, dtype=object) for c in zip(*out, strict=True)), strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, timer = self._held()
        late_at = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
        out, named = [], set()
        for frame in rows:
            for face, nth, operation, person, no_face, no_nth, no_person in zip(*(frame[c].tolist() for c in ("face_id", "nth", "operation", "person", "no_face", "no_nth", "no_person")), strict=True):
                message = operation, None if no_person else person
                if no_face or no_nth or nth < 1:
                    out.append((None if no_face else face, None if no_nth else nth, *message, UNNUMBERED))
                    continue
                named.add(face)
                turn = turns.get(face)
                if turn is None:
                    turn = turns[face] = Turn()
                if (fate := turn.fate(nth, message)) is not None:
                    out.append((face, nth, *message, fate))
        for face in named:
            turns[face].run(face, out, late_at)
        self._kept(turns, timer)
        yield from self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turns, timer = self._held()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for face, turn in turns.items():
            if turn.until and turn.until <= max(now, timer):
                first = min(turn.waiting)
                turn.given_up.append((turn.due, first - 1))
                turn.due = first
                turn.run(face, out, now + self.patience_ms)
        self._kept(turns, 0)
        yield from self._frame(out)

    def close(self) -> None:
        pass


def numbered_messages(ops: DataFrame) -> DataFrame:
    """What the sender does: a message (seq, face_id_list, operation, current_person_id) becomes one to each face, numbered in
    the face's order."""
    one = ops.select("seq", F.explode(F.array_distinct("face_id_list")).alias("face_id"), "operation", F.col("current_person_id").alias("person"))
    return one.withColumn("nth", F.row_number().over(Window.partitionBy("face_id").orderBy("seq")).cast("long"))


def in_turn(messages: DataFrame, patience_ms: int, shares: int = SHARES) -> DataFrame:
    """A stream of MESSAGES with their fates, those due in order; needs the RocksDB state store (`with_rocks`)."""
    face, nth, person = F.col("face_id"), F.col("nth"), F.col("person")
    # integers with nulls among them would become floats
    whole = messages.select(F.pmod(F.xxhash64("face_id"), F.lit(shares)).alias("share"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in ((face, "face_id"), (nth, "nth"), (person, "person"))], "operation", face.isNull().alias("no_face"), nth.isNull().alias("no_nth"), person.isNull().alias("no_person"))
    return whole.groupBy("share").transformWithStateInPandas(InTurn(patience_ms), FATED, "append", "ProcessingTime")


def with_rocks(spark: SparkSession, start: Callable[[], StreamingQuery], *, ends: bool = False) -> StreamingQuery:
    """Starts a query whose state lies in RocksDB; the session's own settings stay as they were.

    Timers that run keep a query busy: it looks for expired ones without end. One that `ends` once its input is read
    looks only when messages come.
    """
    wanted = {PROVIDER: ROCKS} | ({IDLE: "false"} if ends else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def applied_in_turn(table: FaceTable, marks: Marks, aside: str) -> Step:
    """A micro-batch's step: due messages fold into the table of faces, the others are written under a folder."""
    fold = table.apply(marks)

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        due = batch.where(F.col("fate") == DUE)
        fold(due.select(F.col("nth").alias("seq"), F.array("face_id").alias("face_id_list"), "operation", F.col("person").alias("current_person_id")), number)
        batch.where(F.col("fate") != DUE).write.mode("overwrite").parquet(f"{aside}/batch={number}")
        batch.unpersist()

    return step
