"""A gallery of labelled vectors that stays packed between runs: only what belongs to people whose faces changed is packed again.

The gallery is a folder of generations. Each holds the blocks that it packed, an index (which version of each block
counts, and whose vectors are in it) and a fingerprint for each person: how many vectors, and an exclusive or over hashes of
ids and vectors. A refresh works out the fingerprints of the faces as they are (one partial aggregation), finds the people
that differ, are new or are gone, and packs the blocks anew in which they were or will be; vectors of other people in
those blocks come from the old block. Pivots, and how many blocks lie around each, stay as they were built; when twice
as many vectors came in, or more than half of what lies in the folder is out of date, the whole is built again.

A generation counts once its index is there, which is written last; a refresh that failed is done again over what it left. Vectors of another
length than the gallery's take no part.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.operators import nearest as N
from pictorium.sources.shared import written


class Refreshed(NamedTuple):
    """People whose faces differed, blocks packed for them, and blocks in all."""

    people: int
    repacked: int
    blocks: int


class Gallery:
    """See the module. `size`: numbers of a vector; the measure is the cosine."""

    def __init__(self, spark: SparkSession, folder: str, size: int):
        self.spark, self.folder, self.size = spark, folder.rstrip("/"), size

    def generation(self) -> int:
        """The last one whose index was written; -1 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return -1
        names = [status.getPath().getName() for status in files.listStatus(path)]
        done = [int(m.group(1)) for n in names if (m := re.fullmatch(r"index(\d+)", n)) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return max(done, default=-1)

    def _at(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}{number}")

    def _put(self, rows: DataFrame, kind: str, number: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}{number}")
        return self._at(kind, number)

    def _of_size(self, faces: DataFrame) -> DataFrame:
        return N.known_input(faces, cosine=True).where(F.size("vec") == self.size)

    def _prints(self, known: DataFrame) -> DataFrame:
        return known.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id", "vec")).alias("mark"))

    def _shape(self, number: int) -> tuple[np.ndarray, dict[int, int], int, int]:
        """Pivots, blocks around each, vectors when they were built, and the generation that built them: PIVOTS rows at most."""
        rows = sorted(self._at("shape", number).collect(), key=lambda r: r["home"])
        return np.array([r["pivot"] for r in rows]), {r["home"]: r["parts"] for r in rows}, rows[0]["built"], rows[0]["since"]

    def _put_shape(self, pivots: np.ndarray, parts: dict[int, int], built: int, since: int, number: int) -> None:
        rows = [(k, [float(x) for x in p], parts.get(k, 1), built, since) for k, p in enumerate(pivots)]
        self._put(self.spark.createDataFrame(rows, "home int, pivot array<double>, parts int, built long, since int").coalesce(1), "shape", number)

    def _dealt(self, rows: DataFrame, parts: dict[int, int]) -> DataFrame:
        large = rows.groupBy("home", "person_id").count().where(F.col("count") > N.GALLERY_BLOCK).select("home", "person_id", F.ceil(F.col("count") / N.GALLERY_BLOCK).alias("spread"))
        return N.dealt(rows.join(F.broadcast(large), ["home", "person_id"], "left"), parts, N.by_owner(rows)).drop("spread")

    def build(self, faces: DataFrame) -> Refreshed:
        """Packs everything."""
        number, known = self.generation() + 1, self._of_size(faces)
        n = known.count()
        if not n:
            raise ValueError("a gallery needs vectors")
        pivots = N.chosen_pivots(known, n, True)
        rows = written(N.located(known, pivots, True))
        parts = N.block_numbers(rows, N.GALLERY_BLOCK)
        blocks = self._put(N.packed(self._dealt(rows, parts), pivots, True), "blocks", number)
        self._put_shape(pivots, parts, n, number, number)
        people = self._put(self._prints(known), "prints", number).count()
        index = self._put(blocks.select("block", F.lit(number).alias("version"), "owners"), "index", number)
        packed = index.count()
        return Refreshed(people, packed, packed)

    def refresh(self, faces: DataFrame) -> Refreshed:
        """Packs what belongs to people whose faces changed since the last generation."""
        last = self.generation()
        if last < 0:
            return self.build(faces)
        number, known = last + 1, self._of_size(faces)
        pivots, parts, built, since = self._shape(last)
        prints = self._put(self._prints(known), "prints", number)
        index = self._at("index", last)
        held = sum(self._at("blocks", g).count() for g in range(since, last + 1))
        if (prints.agg(F.sum("n")).first()[0] or 0) > 2 * built or held > 2 * index.count():
            return self.build(faces)
        was, now = self._at("prints", last), prints
        changed = was.select("person_id", F.col("n").alias("n_was"), F.col("mark").alias("mark_was")).join(now, "person_id", "full")
        changed = written(changed.where(~(F.col("n").eqNullSafe(F.col("n_was")) & F.col("mark").eqNullSafe(F.col("mark_was")))).select("person_id"))
        fresh = written(self._dealt(written(N.located(known.join(changed, "person_id", "left_semi"), pivots, True)), parts))
        owned = index.select("block", F.explode("owners.person_id").alias("person_id")).join(changed, "person_id", "left_semi").select("block")
        touched = written(owned.union(fresh.select("block")).distinct())
        old = self._blocks(index.join(touched, "block", "left_semi"), since, last).select("block", F.inline("rows")).join(changed, "person_id", "left_anti")
        columns = ["block", "person_id", "id", "vec"]
        blocks = self._put(N.packed(old.select(*columns).unionByName(fresh.select(*columns)), pivots, True), "blocks", number)
        self._put_shape(pivots, parts, built, since, number)
        self._put(index.join(touched, "block", "left_anti").unionByName(blocks.select("block", F.lit(number).alias("version"), "owners")), "index", number)
        return Refreshed(changed.count(), blocks.count(), self._at("index", number).count())

    def _blocks(self, index: DataFrame, since: int, last: int) -> DataFrame:
        """The blocks of an index, each in the version that counts."""
        every = None
        for g in range(since, last + 1):
            rows = self._at("blocks", g).withColumn("version", F.lit(g))
            every = rows if every is None else every.unionByName(rows)
        return every.join(index.select("block", "version"), ["block", "version"], "left_semi").drop("version")

    def read(self) -> N.Blocks:
        """The gallery as `identity.suggestions` and `by_person` take it."""
        last = self.generation()
        pivots, _, _, since = self._shape(last)
        return N.Blocks(pivots, self._blocks(self._at("index", last), since, last), True)
