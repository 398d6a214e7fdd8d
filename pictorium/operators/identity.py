"""Who a face may be: similarity to every labelled face, reduced by person, and ranked."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictorium.config import DEFAULTS, Settings
from pictorium.functions.scorers import Scorer, cosine
from pictorium.operators import nearest as nearest_module
from pictorium.operators.nearest import PERCENTILES, WANTED, Blocks, Ends, ends_at_once, filed, kept_ends, known_blocks, met, nearest, nearest_input, searched
from pictorium.operators.nearest import usable as usable
from pictorium.sources.shared import numbered, written

#: Vectors of one block on either side: a pair of blocks is one matrix product.
FACE_BLOCK, GALLERY_BLOCK = 512, 2_048
#: As `nearest` has it: of a gallery's blocks a task keeps so many numbers for its further faces.
BROADCAST_NUMBERS = nearest_module.BROADCAST_NUMBERS


def _prepared(faces: DataFrame, *more: str) -> DataFrame:
    """id, vec (doubles) and further columns of usable vectors other than zero."""
    rows = faces.select("id", *more, F.col("vec").cast("array<double>").alias("vec"))
    return rows.where(usable(F.col("vec")) & F.exists("vec", lambda x: x != 0))


def tails(pending: DataFrame, gallery: DataFrame, percentiles: Sequence[float], *, per_person: bool = True, measure: Scorer = cosine) -> DataFrame:
    """face_id, person_id (unless per_person is off), n and p: percentiles (linear between ranks) of each face's
    similarities to a person's gallery vectors, or to all but those of people that the face has rejected.

    pending: id, vec, rejected_ids; gallery: id, person_id, vec. Both sides are packed into blocks, a person's vectors
    together, and each block of faces meets each block of the gallery in one task (see `nearest.met`): one matrix product. Of
    its similarities only the ends that the percentiles can lie in are kept for a face and person, some faces at a time, and
    none are shuffled. Faces of another length than the gallery's meet nobody.
    """
    known, asked = _prepared(gallery, "person_id"), _prepared(pending, "rejected_ids")
    known = known.withColumn("size", F.size("vec"))
    people = written(known.groupBy("size", "person_id").agg(F.count(F.lit(1)).alias("of_person")))
    whole = people.groupBy("size").agg(F.sum("of_person").alias("total"), F.count(F.lit(1)).alias("people")).collect()  # one row a length of vectors
    found = None
    for size, total, n_people in whole:
        buckets = max(1, -(-total // GALLERY_BLOCK))
        # a person's vectors are one bucket's, or, of a large person, some buckets'
        person = F.pmod(F.xxhash64("person_id"), F.lit(buckets))
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("of_person") / GALLERY_BLOCK))
        owned = known.where(F.col("size") == size).join(people, ["size", "person_id"])
        packed = owned.groupBy(F.pmod(person + part, F.lit(buckets)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("person_id", "id", "of_person", "vec"))).alias("rows"))
        totals = F.array_sort(F.array_distinct(F.transform("rows", lambda x: F.struct(x["person_id"].alias("person_id"), x["of_person"].alias("of")))))
        _, files = filed(packed.withColumn("of", totals["of"]))
        faces = asked.where(F.size("vec") == size).groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-pending.count() // FACE_BLOCK)))).alias("part")).agg(F.collect_list(F.struct("id", "vec", "rejected_ids")).alias("rows"))
        ends = sum(kept_ends(percentiles, total)) + (2 * n_people if per_person else 0)
        one = None if per_person else total
        rows, _ = met(written(faces.select("rows", F.lit(None).cast(WANTED).alias("wanted"))), files, lambda rows, one=one: Ends(rows, percentiles, measure, one), ends_at_once(ends), PERCENTILES, BROADCAST_NUMBERS)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = pending.sparkSession.createDataFrame([], PERCENTILES)
    return found if per_person else found.drop("person_id")


def _worth_pruning(gallery: DataFrame | Blocks) -> bool:
    """Whether there is more than one block; the outcome is the same either way."""
    return isinstance(gallery, Blocks) or gallery.count() > nearest_module.GALLERY_BLOCK


def by_person(pending: DataFrame, gallery: DataFrame | Blocks, percentile: float = DEFAULTS.percentile, *, measure: Scorer = cosine) -> DataFrame:
    """face_id, person_id, sim_max and sim_p: the greatest similarity to a person's faces, and their percentile.

    The cosine's upper percentiles need each person's nearest faces alone, so blocks that hold none of them are skipped;
    `gallery` may then be packed beforehand. Other measures have no bounds, and low percentiles need the farthest faces.
    """
    if measure is cosine and percentile >= 0.5 and _worth_pruning(gallery):
        if isinstance(gallery, Blocks):
            size = gallery.pivots.shape[1]
            found = searched(nearest_input(pending).where(F.size("vec") == size), gallery, (percentile, 1.0)).rows
        else:
            found = nearest(pending, gallery, (percentile, 1.0), cosine=True).rows
    else:
        found = tails(pending, gallery, (percentile, 1.0), measure=measure)
    return found.select("face_id", "person_id", F.col("p")[1].alias("sim_max"), F.col("p")[0].alias("sim_p"))


def _clamped(weight: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))


def _ranked(people: DataFrame) -> DataFrame:
    return people.withColumn("rank", F.row_number().over(Window.partitionBy("face_id").orderBy(F.desc("sim_max"), "person_id")))


def candidates(people: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The best people above the threshold, ranked by their greatest similarity; the weight is the percentile."""
    top = _ranked(people.where(F.col("sim_max") > settings.similarity_threshold)).where(F.col("rank") <= settings.n_candidates)
    return top.select("face_id", "rank", "person_id", _clamped(F.col("sim_p")).alias("weight"))


def _ignoring(best: DataFrame, pending: DataFrame, ignore_id: int) -> DataFrame:
    """The outcome for faces whose best person isn't like enough: the ignore person with one less the similarity, or,
    where that person is rejected, the best person with the similarity."""
    rejected = pending.select(F.col("id").alias("face_id"), F.coalesce(F.array_contains("rejected_ids", F.lit(ignore_id)), F.lit(False)).alias("refused"))
    out = best.join(rejected, "face_id")
    person = F.when(F.col("refused"), F.col("person_id")).otherwise(F.lit(ignore_id).cast(best.schema["person_id"].dataType))
    return out.select("face_id", F.lit(1).alias("rank"), person.alias("person_id"), _clamped(F.when(F.col("refused"), F.col("sim_max")).otherwise(1 - F.col("sim_max"))).alias("weight"))


def ignored(people: DataFrame, pending: DataFrame, ignore_id: int, settings: Settings = DEFAULTS) -> DataFrame:
    """The ignore branch alone: faces nobody is like enough."""
    best = _ranked(people).where((F.col("rank") == 1) & (F.col("sim_max") <= settings.similarity_threshold))
    return _ignoring(best, pending, ignore_id)


class Suggested(NamedTuple):
    """Suggestions, and how many pairs of blocks met of how many there are."""

    rows: DataFrame
    met: int
    pairs: int


def suggestions(pending: DataFrame, gallery: DataFrame | Blocks, ignore_id: int, settings: Settings = DEFAULTS, *, measure: Scorer = cosine) -> DataFrame:
    """face_id, rank, person_id, weight: at most n candidates a face, or the ignore branch."""
    if measure is cosine and settings.percentile >= 0.5 and _worth_pruning(gallery):
        return suggested(pending, gallery, ignore_id, settings).rows
    ranked = _ranked(by_person(pending, gallery, settings.percentile, measure=measure)).where(F.col("rank") <= settings.n_candidates)
    return _decided(ranked, pending, ignore_id, settings)


def _decided(ranked: DataFrame, pending: DataFrame, ignore_id: int, settings: Settings) -> DataFrame:
    """Ranked people become candidates; where the first isn't like enough, the ignore branch."""
    enough = F.col("sim_max") > settings.similarity_threshold
    refused = F.coalesce(F.array_contains("rejected_ids", F.lit(ignore_id)), F.lit(False))
    seen = ranked.where(enough | (F.col("rank") == 1)).join(pending.select(F.col("id").alias("face_id"), refused.alias("refused")), "face_id")
    person = F.when(enough | F.col("refused"), F.col("person_id")).otherwise(F.lit(ignore_id).cast(ranked.schema["person_id"].dataType))
    weight = F.when(enough, F.col("sim_p")).when(F.col("refused"), F.col("sim_max")).otherwise(1 - F.col("sim_max"))
    return seen.select("face_id", "rank", person.alias("person_id"), _clamped(weight).alias("weight"))


def suggested(pending: DataFrame, gallery: DataFrame | Blocks, ignore_id: int, settings: Settings = DEFAULTS) -> Suggested:
    """Suggestions by the cosine, each step with no more than it needs:

    1. who is like enough: each person's nearest face, but of blocks within the threshold only;
    2. of the n best of these, the percentile: the upper end of their similarities, for these pairs alone;
    3. for the faces that nobody is like enough, the nearest person of all.
    """
    sizes = {gallery.pivots.shape[1]: gallery} if isinstance(gallery, Blocks) else known_blocks(gallery, cosine=True)
    asked = nearest_input(pending)
    parts, met, pairs = [], 0, 0
    for size, blocks in sizes.items():
        of_size = asked.where(F.size("vec") == size)
        similar = lambda near: -F.get(near, F.lit(0))["v"]
        near = searched(of_size, blocks, 1, within=math.sqrt(max(2 - 2 * settings.similarity_threshold, 0)))
        people = near.rows.select("face_id", "person_id", similar("near").alias("sim_max"))
        ranked = written(_ranked(people.where(F.col("sim_max") > settings.similarity_threshold)).where(F.col("rank") <= settings.n_candidates))
        tail = searched(of_size.join(ranked.select(F.col("face_id").alias("id")).distinct(), "id", "left_semi"), blocks, (settings.percentile,), only=ranked)
        parts.append(ranked.join(tail.rows.select("face_id", "person_id", F.get("p", F.lit(0)).alias("sim_p")), ["face_id", "person_id"]).select("face_id", "person_id", "sim_max", "sim_p", "rank"))
        lone = searched(of_size.join(ranked.select(F.col("face_id").alias("id")).distinct(), "id", "left_anti"), blocks, 1, best=True)
        alone = _ranked(lone.rows.select("face_id", "person_id", similar("near").alias("sim_max"), F.lit(None).cast("double").alias("sim_p"))).where("rank = 1")
        parts.append(alone.select("face_id", "person_id", "sim_max", "sim_p", "rank"))
        met, pairs = met + near.met + tail.met + lone.met, pairs + near.pairs
    if not parts:
        return Suggested(pending.sparkSession.createDataFrame([], "face_id long, rank int, person_id long, weight double"), 0, 0)
    return Suggested(_decided(reduce(DataFrame.unionByName, parts), pending, ignore_id, settings), met, pairs)


def as_candidates(rows: DataFrame) -> DataFrame:
    """Suggestions as a face's array of candidates."""
    lists = rows.groupBy("face_id").agg(F.sort_array(F.collect_list(F.struct("rank", "person_id", "weight"))).alias("c"))
    return lists.select(F.col("face_id").alias("id"), F.transform("c", lambda x: F.struct(x["person_id"].alias("person_id"), x["weight"].alias("weight"))).alias("candidates"))


def eligible_people(people: DataFrame, faces: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Whose faces make the gallery: more than min_faces declared ones, and not an ignored name."""
    counts = faces.groupBy(F.col("declared_person_id").alias("id")).count().where(F.col("count") > settings.min_faces)
    return people.where(~F.col("person_name").isin(list(settings.ignored_names))).join(counts.select("id"), "id", "left_semi")


def pending_faces(faces: DataFrame, unassigned_id: int) -> DataFrame:
    """Unassigned faces with a usable vector and no candidate yet."""
    return faces.where((F.col("declared_person_id") == unassigned_id) & usable(F.col("vec")) & (F.size("candidates") == 0))


def temporally_nearest(asked: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """For each asked face and person, the n faces of that person nearest in time, equal ones by their ids.

    asked: face_id, at, and optionally own_id, a known face that isn't its own neighbour; known: person_id, gallery_id,
    at. Each question goes to each person, as the result does. Faces and questions are numbered together in time by
    ranges (a person with most of the faces is many ranges), and only the n faces before and the n from there on are
    looked up by their numbers, one more where the face itself may be among them.
    """
    people = known.select("person_id").distinct()
    own = F.col("own_id").cast("long") if "own_id" in asked.columns else F.lit(None).cast("long")
    questions = asked.select("face_id", "at", own.alias("own_id")).crossJoin(F.broadcast(people))  # people: the result has as many rows a question
    blank = F.lit(None).cast("long")
    every = known.select("person_id", F.col("gallery_id").cast("long").alias("gallery_id"), "at", F.lit(1).alias("is_known"), blank.alias("face_id"), blank.alias("own_id")).unionByName(questions.select("person_id", blank.alias("gallery_id"), "at", F.lit(0).alias("is_known"), F.col("face_id").cast("long").alias("face_id"), "own_id"))
    found = []
    for later in (True, False):
        # a question stands before the faces of its own moment; nearer faces of one moment have the smaller ids
        placed = numbered(every, ["at", "is_known", F.asc("gallery_id") if later else F.desc("gallery_id"), "face_id"], ["person_id"], counts=F.col("is_known"))
        more = F.when(F.col("own_id").isNull(), n).otherwise(n + 1)
        first, last = (F.col("number") + 1, F.col("number") + more) if later else (F.col("number") - more + 1, F.col("number"))
        looked = placed.where("is_known = 0").select("face_id", "own_id", "person_id", F.col("at").alias("asked_at"), F.explode(F.sequence(first, last)).alias("number"))
        found.append(looked.join(placed.where("is_known = 1").select("person_id", "number", "gallery_id", F.col("at").alias("known_at")), ["person_id", "number"]))
    near = found[0].unionByName(found[1]).where("own_id is null or gallery_id <> own_id").withColumn("apart", F.abs(F.col("asked_at") - F.col("known_at")))
    place = F.row_number().over(Window.partitionBy("face_id", "person_id").orderBy("apart", "gallery_id"))
    return near.withColumn("place", place).where(F.col("place") <= n).select("face_id", "person_id", "place", "gallery_id", "apart")


def nearest_distances(asked: DataFrame, known: DataFrame, k: int, *, per_person: bool = True) -> DataFrame:
    """face_id, person_id, gallery_id and d (Euclidean): of each person (or of all vectors, as person 0's), the k known
    vectors nearest to each asked one, itself left out; equal ones by their ids. asked, known: id, vec, known with person_id."""
    found = nearest(asked.select("id", "vec"), known, k, per_person=per_person, others_only=True).rows
    return found.select("face_id", "person_id", F.explode("near").alias("near")).select("face_id", "person_id", F.col("near.id").alias("gallery_id"), F.col("near.v").alias("d"))


def mean_of_smallest(distances: DataFrame, by: tuple[str, ...], value: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return distances.withColumn("place", place).where(F.col("place") <= k).groupBy(*by).agg(F.avg(value).alias("mean_smallest"))
