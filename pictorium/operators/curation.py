"""Changes to faces and people as whole-table transforms. Counters are never kept up: catalogue.counters derives them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.config import UNASSIGNED
from pictorium.functions import values as V
from pictorium.operators.ingest import new_ids
from pictorium.schema import CANDIDATES, no_candidates

#: The operations of a message.
OPERATIONS = ("close_unassigned", "close_ignored", "close_assigned", "confirm_proposed", "verify_face")


@dataclass(frozen=True)
class Marks:
    """Ids of the people with a meaning of their own."""

    unassigned: int
    soft_ignore: int
    hard_ignore: int


def _set(faces: DataFrame, hit: Column, **changes: Column) -> DataFrame:
    return faces.withColumns({c: F.when(F.coalesce(hit, F.lit(False)), v).otherwise(F.col(c)) for c, v in changes.items()})


def associated(faces: DataFrame, hit: Column, person_id: Column | int) -> DataFrame:
    """Declares the faces to be a person: not verified or written yet, and without candidates."""
    person = person_id if isinstance(person_id, Column) else F.lit(person_id).cast("long")
    return _set(faces, hit, declared_person_id=person, validated=F.lit(False), written_to_photo_metadata=F.lit(False), candidates=no_candidates())


def verified(faces: DataFrame, hit: Column) -> DataFrame:
    return _set(faces, hit, validated=F.lit(True))


def without(candidates: Column, person_id: Column) -> Column:
    """The candidates less one person; those after it move up."""
    return F.filter(candidates, lambda c: c["person_id"] != person_id)


def rejected(faces: DataFrame, hit: Column, person_id: Column | int) -> DataFrame:
    """Takes a person off the candidates of faces that have it there, and remembers that."""
    person = person_id if isinstance(person_id, Column) else F.lit(person_id).cast("long")
    among = hit & F.exists("candidates", lambda c: c["person_id"] == person)
    return _set(faces, among, candidates=without(F.col("candidates"), person), rejected_ids=F.array_union(F.coalesce("rejected_ids", F.array().cast("array<bigint>")), F.array(person)))


def candidate_placed(faces: DataFrame, hit: Column, slot: int, person_id: int, weight: float) -> DataFrame:
    """Puts a person with a weight of 0 to 1 into a slot (1 to 5) of the candidates; gaps before it close up."""
    if not 1 <= slot <= 5:
        raise ValueError("slots run from 1 to 5")
    if not 0 <= weight <= 1.000001:
        raise ValueError("weights run from 0 to 1")
    one = F.array(F.struct(F.lit(person_id).cast("long").alias("person_id"), F.lit(float(weight)).alias("weight"))).cast(CANDIDATES)
    had = F.coalesce(F.col("candidates"), no_candidates())
    return _set(faces, hit, candidates=F.concat(F.slice(had, 1, slot - 1), one, F.slice(had, slot + 1, 5)))


def dates_recomputed(images: DataFrame, *tags: str, keep_epoch: bool = True) -> DataFrame:
    """date_taken from the earliest readable of the camera's tags; images without any stay as they are.

    keep_epoch leaves date_taken_utc alone.
    """
    first = V.earliest(*[V.exif_date(F.col(t)) for t in tags]) if len(tags) > 1 else V.exif_date(F.col(tags[0]))
    changes = {"date_taken": first, "date_taken_valid": F.lit(True)}
    if not keep_epoch:
        changes["date_taken_utc"] = V.epoch_seconds(first)
    return _set(images, first.isNotNull(), **changes)


def cleared(faces: DataFrame, hit: Column, unassigned_id: int, *, to_null: bool = False) -> DataFrame:
    """Back to nobody: the unassigned person, so that suggestions come again, or no person at all."""
    nobody = F.lit(None).cast("long") if to_null else F.lit(unassigned_id).cast("long")
    return _set(faces, hit, declared_person_id=nobody, validated=F.lit(False), candidates=no_candidates())


def suggestions_reset(faces: DataFrame, unassigned_id: int, *, rejections_too: bool = True) -> DataFrame:
    """No candidates anywhere; unassigned faces forget their rejections as well."""
    out = faces.withColumn("candidates", no_candidates())
    return _set(out, F.col("declared_person_id") == unassigned_id, rejected_ids=F.lit(None).cast("array<bigint>")) if rejections_too else out


def assigned_cleared(faces: DataFrame, unassigned_id: int) -> DataFrame:
    """No candidates for any face that isn't the unassigned person's; a face without a person counts as such."""
    return _set(faces, ~F.coalesce(F.col("declared_person_id") == unassigned_id, F.lit(False)), candidates=no_candidates())


def repointed(faces: DataFrame, old: int, new: int | None) -> DataFrame:
    """Every mention of a person by another one (or none), among declared people, candidates and rejections.

    A face's candidates keep their order; a person that would stand there twice keeps the first place, and nobody takes
    none. A rejection of the old person is one of the new.
    """
    person = F.lit(new).cast("long")
    to = lambda c: F.when(c == old, person).otherwise(c)
    moved = F.transform("candidates", lambda c: F.struct(to(c["person_id"]).alias("person_id"), c["weight"].alias("weight")))
    people = F.transform("candidates", lambda c: to(c["person_id"]))
    first = F.filter(moved, lambda c, i: c["person_id"].isNotNull() & (F.array_position(people, c["person_id"]) == i + 1))
    rejected = F.array_distinct(F.filter(F.transform("rejected_ids", to), lambda x: x.isNotNull()))
    changes = {"declared_person_id": to(F.col("declared_person_id")), "candidates": first.cast(CANDIDATES)}
    return faces.withColumns(changes | ({"rejected_ids": rejected} if "rejected_ids" in faces.columns else {}))


def people_merged(people: DataFrame, faces: DataFrame, old: int, into: int) -> tuple[DataFrame, DataFrame]:
    return people.where(F.col("id") != old), repointed(faces, old, into)


def person_deleted(people: DataFrame, faces: DataFrame, person: int, unassigned_id: int) -> tuple[DataFrame, DataFrame]:
    """Without a person, whose faces become unassigned. The unassigned person can't go."""
    if person == unassigned_id:
        raise ValueError("the unassigned person can't be deleted")
    return people.where(F.col("id") != person), repointed(faces, person, unassigned_id)


def people_ensured(people: DataFrame, names: DataFrame, unnamed: str = UNASSIGNED) -> DataFrame:
    """The people and, with ids after the greatest one in the order of their names, those of `names` (name) that aren't
    among them. A face without a name is the unassigned person's."""
    wanted = names.select(F.coalesce("name", F.lit(unnamed)).alias("person_name")).distinct()
    fresh = wanted.join(people.select("person_name"), "person_name", "left_anti")
    last = people.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    return people.unionByName(new_ids(fresh, last, ("person_name",)), allowMissingColumns=True)


def tagged(faces: DataFrame, people: DataFrame, unnamed: str = UNASSIGNED) -> tuple[DataFrame, DataFrame]:
    """People and faces after faces with names read from their pictures (`name`, which may be null) came in: each name
    is found or added, and its faces are declared so."""
    every = people_ensured(people, faces.select("name"), unnamed)
    named = faces.withColumn("person_name", F.coalesce("name", F.lit(unnamed))).join(every.select(F.col("id").alias("tagged_id"), "person_name"), "person_name")
    return every, named.withColumn("declared_person_id", F.col("tagged_id")).withColumn("written_to_photo_metadata", F.lit(True)).select(*[c for c in faces.columns if c != "name"])


def face_to_new_person(people: DataFrame, faces: DataFrame, face_id: int, name: str, highlight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A new person of that name, shown by the face's picture, and the face declared so."""
    one = faces.where(F.col("id") == face_id).select(F.lit(name).alias("person_name"), (F.lit(None).cast("string") if highlight is None else highlight).alias("highlight_img"))
    last = people.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    person = one.select(F.lit(last + 1).cast("long").alias("id"), *[c for c in one.columns if c in people.columns])
    return people.unionByName(person, allowMissingColumns=True), associated(faces, F.col("id") == face_id, last + 1)


def thumbnail_set(people: DataFrame, faces: DataFrame, face_id: int, highlight: Column) -> DataFrame:
    """The face's picture (`highlight`, over the face's columns) becomes that of its declared person."""
    one = faces.where(F.col("id") == face_id).select(F.col("declared_person_id").alias("id"), highlight.alias("new_highlight"))
    had = people if "highlight_img" in people.columns else people.withColumn("highlight_img", F.lit(None).cast("string"))
    return had.join(F.broadcast(one), "id", "left").withColumn("highlight_img", F.coalesce("new_highlight", "highlight_img")).drop("new_highlight")


def face_ignored(faces: DataFrame, face_id: int, kind: str, marks: Marks) -> DataFrame:
    """One face to the soft or the hard ignore person."""
    if kind not in ("soft", "hard"):
        raise ValueError("a face is ignored 'soft' or 'hard'")
    return associated(faces, F.col("id") == face_id, marks.soft_ignore if kind == "soft" else marks.hard_ignore)


def refusals(ops: DataFrame) -> DataFrame:
    """Messages with `refused`: why one can't be applied, null where it can. No message fails a stream."""
    kind, needs = F.col("operation"), F.col("operation").isin("close_assigned", "confirm_proposed")
    reason = F.when(kind.isNull() | ~kind.isin(*OPERATIONS), "no such operation").when(F.coalesce(F.size("face_id_list"), F.lit(0)) <= 0, "no faces").when(needs & F.col("current_person_id").isNull(), "no person")
    return ops.withColumn("refused", reason)


def person_renamed(people: DataFrame, person: int, name: str) -> DataFrame:
    return people.withColumn("person_name", F.when(F.col("id") == person, F.lit(name)).otherwise(F.col("person_name")))


def flag_toggled(people: DataFrame, person: int) -> DataFrame:
    return people.withColumn("further_images_unlikely", F.when(F.col("id") == person, ~F.col("further_images_unlikely")).otherwise(F.col("further_images_unlikely")))


def images_deleted(images: DataFrame, faces: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the images of `gone` (id) and their faces."""
    return images.join(gone, "id", "left_anti"), faces.join(gone.withColumnRenamed("id", "image_id"), "image_id", "left_anti")


def marked_processed(images: DataFrame, hit: Column, value: bool = True) -> DataFrame:
    return _set(images, hit, is_processed=F.lit(value))


def _step(state: Column, op: Column, marks: Marks) -> Column:
    """A face's state after one operation; what doesn't apply leaves it as it was."""
    kind, person = op["operation"], op["person"]
    first = F.get(state["candidates"], F.lit(0))["person_id"]
    ignored = state["declared"].isin(marks.soft_ignore, marks.hard_ignore) | F.coalesce(first == marks.soft_ignore, F.lit(False))
    has = F.exists(state["candidates"], lambda c: c["person_id"] == person)
    to = F.when(kind == "close_unassigned", F.lit(marks.soft_ignore).cast("long")).when((kind == "close_ignored") & F.coalesce(ignored, F.lit(False)), F.lit(marks.hard_ignore).cast("long")).when(kind == "confirm_proposed", person)
    refuse = (kind == "close_assigned") & F.coalesce(has, F.lit(False))
    return F.struct(
        F.coalesce(to, state["declared"]).alias("declared"),
        F.when(to.isNotNull(), F.lit(False)).when(kind == "verify_face", F.lit(True)).otherwise(state["validated"]).alias("validated"),
        F.when(to.isNotNull(), F.lit(False)).otherwise(state["written"]).alias("written"),
        F.when(to.isNotNull(), no_candidates()).when(refuse, without(state["candidates"], person)).otherwise(state["candidates"]).alias("candidates"),
        F.when(refuse, F.array_union(state["rejected"], F.array(person))).otherwise(state["rejected"]).alias("rejected"),
    )


def bulk_applied(faces: DataFrame, ops: DataFrame, marks: Marks) -> DataFrame:
    """Faces after all operations, each face's in the order of `seq`: one fold a face, so one may depend on another.

    ops: seq, face_id_list, operation, current_person_id. Ids without a face and unknown operations are passed over.
    """
    one = ops.where(F.col("operation").isin(*OPERATIONS)).select("seq", F.explode("face_id_list").alias("id"), "operation", F.col("current_person_id").cast("long").alias("person"))
    by_face = one.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "operation", "person"))).alias("ops"))
    start = F.struct(F.col("declared_person_id").alias("declared"), F.col("validated").alias("validated"), F.col("written_to_photo_metadata").alias("written"), F.col("candidates").cast(CANDIDATES).alias("candidates"), F.coalesce(F.col("rejected_ids"), F.array().cast("array<bigint>")).alias("rejected"))
    kind = "struct<declared:bigint,validated:boolean,written:boolean,candidates:" + CANDIDATES + ",rejected:array<bigint>>"
    end = F.aggregate("ops", start.cast(kind), lambda state, op: _step(state, op, marks).cast(kind))
    folded = faces.join(by_face, "id", "left").withColumn("end", F.when(F.col("ops").isNotNull(), end))
    columns = {"declared_person_id": "declared", "validated": "validated", "written_to_photo_metadata": "written", "candidates": "candidates", "rejected_ids": "rejected"}
    return folded.withColumns({c: F.when(F.col("end").isNotNull(), F.col("end")[n]).otherwise(F.col(c)) for c, n in columns.items()}).select(*faces.columns)
