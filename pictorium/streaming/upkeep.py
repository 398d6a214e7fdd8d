"""Aggregates kept up by differences: what each change added and took away, never a new count of everything.

A view is sums by key. It starts with one whole count; after that every change hands in the rows it found and those it
left, each as contributions (key and measures), and only the difference of the keys that changed is written, under the
change's number. Reading adds the base and the differences up. Every FOLD changes they are folded into a new base, so a
read is of FOLD small tables at most. A change that is handed in again under its number, after a failure, replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.operators.curation import Marks
from pictorium.sources.shared import removed
from pictorium.streaming.curation import FaceTable, by_id

#: Differences that are kept one by one before they are folded into the base.
FOLD = 16
PERSON_MEASURES = ("num_faces", "num_unverified_faces", "num_possibilities", "num_possibilities_any")


class SumView:
    """Sums of `measures` by `key` under a folder: base<n> holds all changes up to n, change<n> the difference of one."""

    def __init__(self, spark: SparkSession, folder: str, key: str, measures: Sequence[str], fold: int = FOLD):
        self.spark, self.folder, self.key, self.measures, self.fold = spark, folder, key, tuple(measures), fold
        self.schema = None

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(*[F.sum(m).cast("long").alias(m) for m in self.measures]).where(" or ".join(f"{m} <> 0" for m in self.measures))

    def _read(self, *names: str) -> DataFrame:
        if self.schema is None:
            self.schema = self.spark.read.parquet(f"{self.folder}/{names[0]}").schema
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def base(self, number: int) -> int:
        """The change up to which the base goes that a read after change `number` begins with."""
        return -1 if number < 0 else (number + 1) // self.fold * self.fold - 1

    def start(self, contributions: DataFrame) -> None:
        sums = self._sums(contributions)
        self.schema = sums.schema
        sums.write.mode("overwrite").parquet(f"{self.folder}/base-1")

    def change(self, number: int, before: DataFrame, after: DataFrame) -> None:
        """Change `number` (from 0, none left out): the contributions of the rows that it touches, as they were and as they are."""
        gone = before.select(self.key, *[(-F.col(m)).alias(m) for m in self.measures])
        self._sums(gone.unionByName(after.select(self.key, *self.measures))).write.mode("overwrite").parquet(f"{self.folder}/change{number}")
        if self.base(number) == number:
            self._sums(self._read(*self._parts(number, self.base(number - 1)))).write.mode("overwrite").parquet(f"{self.folder}/base{number}")
            # the base before this one stays until the next is written: a change that is run again begins with it
            last = self.base(number - self.fold)
            for n in range(self.base(last - 1) + 1, last + 1):
                removed(self.spark, f"{self.folder}/change{n}")
            if last > -1:
                removed(self.spark, f"{self.folder}/base{self.base(last - 1)}")

    def _parts(self, number: int, base: int) -> list[str]:
        return [f"base{base}", *[f"change{n}" for n in range(base + 1, number + 1)]]

    def read(self, number: int) -> DataFrame:
        """key and measures after a change (-1: at the start); keys whose sums are all 0 are left out."""
        return self._sums(self._read(*self._parts(number, self.base(number))))


def person_contributions(faces: DataFrame) -> DataFrame:
    """person_id and what each face adds to that person's counts: as declared, unverified, first candidate, any candidate."""
    kind = "array<struct<person_id:bigint,num_faces:int,num_unverified_faces:int,num_possibilities:int,num_possibilities_any:int>>"
    declared = F.struct(F.col("declared_person_id").alias("person_id"), F.lit(1).alias("num_faces"), F.when(~F.col("validated"), 1).otherwise(0).alias("num_unverified_faces"), F.lit(0).alias("num_possibilities"), F.lit(0).alias("num_possibilities_any"))
    asked = F.transform("candidates", lambda c, i: F.struct(c["person_id"].alias("person_id"), F.lit(0).alias("num_faces"), F.lit(0).alias("num_unverified_faces"), F.when(i == 0, 1).otherwise(0).alias("num_possibilities"), F.lit(1).alias("num_possibilities_any")))
    rows = faces.select(F.explode(F.concat(F.array(declared).cast(kind), F.coalesce(asked.cast(kind), F.array().cast(kind)))).alias("c")).select("c.*")
    return rows.where("person_id is not null")


def directory_contributions(images: DataFrame) -> DataFrame:
    """directory_id, 1 for each image, and 1 for each that is processed."""
    return images.where("directory_id is not null").select("directory_id", F.lit(1).alias("num_images"), F.when(F.col("is_processed"), 1).otherwise(0).alias("num_processed"))


def counted(table: FaceTable, view: SumView, marks: Marks) -> Callable[[DataFrame, int], None]:
    """A micro-batch's step: folds its messages into the table of faces and keeps the people's counts up.

    Only the buckets that the messages name are read, and of them only the faces named.
    """
    fold = table.apply(marks)

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        before = table.listed(number - 1)
        fold(batch, number)
        after = table.listed(number)
        touched = [b for b, v in after.items() if before.get(b) != v]
        if not touched:
            nothing = view.read(number - 1).limit(0)
            view.change(number, nothing, nothing)
            batch.unpersist()
            return
        named = batch.select(F.explode("face_id_list").alias("id")).distinct()
        named = by_id(named)
        sides = [table.named({b: versions[b] for b in touched}, named) for versions in (before, after)]
        view.change(number, *map(person_contributions, sides))
        batch.unpersist()

    return step


def with_counts(people: DataFrame, counts: DataFrame) -> DataFrame:
    """People (id, person_name) with their counts, 0 where there are none."""
    return people.select("id", "person_name").join(counts.withColumnRenamed("person_id", "id"), "id", "left").na.fill(0, list(PERSON_MEASURES))
