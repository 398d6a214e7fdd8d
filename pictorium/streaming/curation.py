"""Operation messages as a stream: each micro-batch folds into the table of faces, in the order of arrival."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pictorium.operators.curation import Marks, bulk_applied
from pictorium.sources.shared import removed, shared_folder, written

#: Buckets of a table by the hash of the face's id: a micro-batch reads those that its messages name.
BUCKETS = 64
#: Versions of a bucket that are kept beside each other before it is written whole again.
KEPT = 16
#: Rows of an arrival, about, that a file takes, and so one task that writes it.
ROWS_A_FILE = 500_000
#: So many ids of changed faces are broadcast (some 24 bytes each); of more, the faces move to them.
BROADCAST_IDS = 5_000_000


def by_id(ids: DataFrame) -> DataFrame:
    """Ids to join faces with: broadcast if they are few enough, so that the faces stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def latest(rows: DataFrame) -> DataFrame:
    """Of each face the last version."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_version")))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


class FaceTable:
    """The faces under a folder, in buckets by id; a list per micro-batch says which versions make up each bucket.

    A bucket's first version is whole, each further one holds the faces that a batch changed; after KEPT of them it is
    written whole again. Buckets that no message names stay as they are. A batch that is run again after a failure starts
    from the list of batch n - 1 and writes its faces and its list anew, so no message is applied twice. Versions that
    neither list n nor list n - 1 names are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.schema = None

    def bucket(self, key: str) -> F.Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.buckets)).cast("int")

    def path(self, bucket: int, version: int) -> str:
        return f"{self.folder}/v{version}/bucket={bucket}"

    def listed(self, number: int) -> dict[int, list[int]]:
        """Versions of the buckets after a batch, the whole one first: at most KEPT rows a bucket."""
        out: dict[int, list[int]] = {}
        for r in sorted(self.spark.read.parquet(f"{self.folder}/list{number}").collect()):
            out.setdefault(r["bucket"], []).append(r["version"])
        return out

    def _list(self, number: int, versions: dict[int, list[int]]) -> None:
        rows = [(b, v) for b, held in sorted(versions.items()) for v in held]
        self.spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list{number}")

    def _write(self, faces: DataFrame, number: int) -> set[int]:
        """Writes faces as a version and gives the buckets that have any."""
        cut = faces.withColumns({"_version": F.lit(number).cast("long"), "bucket": self.bucket("id")})
        cut.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v{number}")
        return {r["bucket"] for r in self.spark.read.schema("bucket int").parquet(f"{self.folder}/v{number}").distinct().collect()}

    def start(self, faces: DataFrame) -> None:
        self.schema = faces.withColumn("_version", F.lit(0).cast("long")).schema
        self._list(-1, {b: [-1] for b in self._write(faces, -1)})

    def rows(self, versions: dict[int, list[int]]) -> DataFrame:
        """What the versions hold: a face may stand in several (see `latest`)."""
        paths = [self.path(b, v) for b, held in sorted(versions.items()) for v in held]
        if self.schema is None:
            self.schema = self.spark.read.parquet(paths[0]).schema
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _whole(self, versions: dict[int, list[int]]) -> DataFrame:
        first = self.rows({b: held[:1] for b, held in versions.items()})
        if all(len(held) == 1 for held in versions.values()):
            return first
        changed = latest(self.rows({b: held[1:] for b, held in versions.items() if held[1:]}))
        return first.join(by_id(changed.select("id")), "id", "left_anti").unionByName(changed)

    def read(self, number: int) -> DataFrame:
        """The faces after a batch."""
        return self._whole(self.listed(number)).drop("_version")

    def named(self, versions: dict[int, list[int]], ids: DataFrame) -> DataFrame:
        """The faces of some ids alone (`by_id`): only these are shuffled, to find their last versions."""
        return latest(self.rows(versions).join(ids, "id", "left_semi")).drop("_version")

    def apply(self, marks: Marks) -> Callable[[DataFrame, int], None]:
        def step(batch: DataFrame, number: int) -> None:
            before = self.listed(number - 1)
            ids = batch.select(F.explode("face_id_list").alias("id")).distinct().persist()
            touched = {r["bucket"]: before[r["bucket"]] for r in ids.select(self.bucket("id").alias("bucket")).distinct().collect() if r["bucket"] in before}
            after = dict(before)
            if touched:
                known = by_id(ids)
                changed = bulk_applied(self.named(touched, known), batch, marks)
                full = {b: held for b, held in touched.items() if len(held) >= KEPT}
                if full:
                    changed = changed.unionByName(self._whole(full).drop("_version").join(known, "id", "left_anti"))
                for b in self._write(changed, number):
                    after[b] = [number] if b in full else [*before[b], number]
            self._list(number, after)
            ids.unpersist()
            if number > 0:
                # what the list before last named and the last one doesn't
                for b, held in self.listed(number - 2).items():
                    for v in held:
                        if v not in before[b]:
                            removed(self.spark, self.path(b, v))

        return step


Step = Callable[[DataFrame, int], None]


def started(ops: DataFrame, step: Step, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Hands a stream's micro-batches to a step. One query per checkpoint: it can't run twice at once."""
    return ops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def arrived(rows: DataFrame, folder: str, order: str, arrivals: int) -> DataFrame:
    """Writes rows as files, some of them at a time by a column's order, and reads them as a stream, an arrival a micro-batch."""
    # what makes the rows runs once, in all its tasks
    rows = written(rows)
    cuts = rows.approxQuantile(order, [k / arrivals for k in range(1, arrivals)], 0.01)
    edges = [None, *sorted(set(cuts)), None]
    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows if low is None else rows.where(F.col(order) > low)
        parts.append(part if high is None else part.where(F.col(order) <= high))
    # every arrival is as many files, each by one task: as many are a micro-batch
    files = max(1, rows.count() // (len(parts) * ROWS_A_FILE))
    slot = F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int")
    if files > 1 and any(part.select(slot).distinct().count() < files for part in parts):
        files = 1
    # a file source takes files by their age: each arrival is written after the one before
    for part in parts:
        if files == 1:
            part.coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(folder)
        else:
            part.withColumn("_slot", slot).repartition(files, "_slot").sortWithinPartitions("_slot", order).write.mode("append").option("maxRecordsPerFile", 0).partitionBy("_slot").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder).select(*rows.columns)


def last_batch(query: StreamingQuery) -> int:
    """Waits for the end of a query and gives its last micro-batch's number; -1 if nothing came."""
    query.awaitTermination()
    done = [json.loads(p) if isinstance(p, str) else p for p in query.recentProgress]
    return max((int(p["batchId"]) for p in done if int(p["numInputRows"]) > 0), default=-1)


def replayed(spark: SparkSession, faces: DataFrame, ops: DataFrame, marks: Marks, arrivals: int = 3) -> DataFrame:
    """Lets the messages arrive as files, some of them at a time in their order, streams them and returns the faces."""
    folder = shared_folder(spark)
    table = FaceTable(spark, f"{folder}/faces")
    table.start(faces)
    stream = arrived(ops, f"{folder}/ops", "seq", arrivals)
    return table.read(last_batch(started(stream, table.apply(marks), f"{folder}/checkpoint")))
