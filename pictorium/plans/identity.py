"""Similarity, suggestions and neighbours in time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.config import DEFAULTS
from pictorium.functions import values as V
from pictorium.operators import identity as I
from pictorium.operators.gallery import Gallery
from pictorium.plans import stand_ins as S
from pictorium.plans.registry import query
from pictorium.sources.shared import shared_folder

#: The stand-in vectors are far apart: the library's default would leave nobody above it.
SETTINGS = replace(DEFAULTS, similarity_threshold=0.35)
IGNORE_ID = 3

_PAIRS = S.VECTORS_SQL + """, norms AS (SELECT *, sqrt(list_dot_product(vec, vec)) AS norm FROM vectors),
  sims AS (SELECT a.id AS face_id, b.person_id, b.id AS gallery_id, list_dot_product(a.vec, b.vec) / (a.norm * b.norm) AS sim
  FROM norms a, norms b WHERE a.id % 5 = 0 AND b.id % 5 <> 0 AND b.person_id <> a.id % 7),
  by_person AS (SELECT face_id, person_id, max(sim) AS sim_max, quantile_cont(sim, 0.99) AS sim_p FROM sims GROUP BY 1, 2),
  top AS (SELECT face_id, row_number() OVER (PARTITION BY face_id ORDER BY sim_max DESC, person_id) AS rank, person_id,
  greatest(0, least(1, sim_p)) AS weight FROM by_person WHERE sim_max > 0.35 QUALIFY rank <= 5),
  best AS (SELECT face_id, max(sim_max) AS top, arg_min(person_id, (-sim_max, person_id)) AS person FROM by_person GROUP BY 1),
  low AS (SELECT face_id, CAST(1 AS BIGINT) AS rank, CASE WHEN face_id % 7 = 3 THEN person ELSE 3 END AS person_id,
  greatest(0, least(1, CASE WHEN face_id % 7 = 3 THEN top ELSE 1 - top END)) AS weight FROM best WHERE top <= 0.35)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = S.vectors(spark, sf_dir)
    pending = vectors.where(F.col("id") % 5 == 0).withColumn("rejected_ids", F.array(F.col("id") % 7))
    return pending, vectors.where(F.col("id") % 5 != 0)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.by_person(*_sides(spark, sf_dir))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("face_id", F.col("rank").cast("long").alias("rank"), F.col("person_id").cast("long").alias("person_id"), S.rounded(F.col("weight")).alias("weight"))


_SHOWN_SQL = "SELECT face_id, rank, CAST(person_id AS BIGINT) AS person_id, round(weight, 6) AS weight FROM "


@query("SELECT face_id, person_id, round(sim_max, 6) AS sim_max, round(sim_p, 6) AS sim_p FROM by_person", _PAIRS)
def face_person_similarity(spark, sf_dir):
    return _people(spark, sf_dir).select("face_id", "person_id", S.rounded(F.col("sim_max")).alias("sim_max"), S.rounded(F.col("sim_p")).alias("sim_p"))


@query(_SHOWN_SQL + "top", _PAIRS)
def identity_top5(spark, sf_dir):
    return _shown(I.candidates(_people(spark, sf_dir), SETTINGS))


@query(_SHOWN_SQL + "low", _PAIRS)
def identity_ignore_branch(spark, sf_dir):
    pending, gallery = _sides(spark, sf_dir)
    return _shown(I.ignored(I.by_person(pending, gallery), pending, IGNORE_ID, SETTINGS))


@query(f"SELECT * FROM ({_SHOWN_SQL} top UNION ALL {_SHOWN_SQL} low)", _PAIRS)
def identity_suggestions(spark, sf_dir):
    return _shown(I.suggestions(*_sides(spark, sf_dir), IGNORE_ID, SETTINGS))


@query(f"SELECT * FROM ({_SHOWN_SQL} top UNION ALL {_SHOWN_SQL} low)", _PAIRS)
def gallery_suggestions(spark, sf_dir):
    """From a gallery that was packed when three people's faces were others, and brought up to date."""
    pending, known = _sides(spark, sf_dir)
    person = F.col("person_id")
    # of one person some faces were missing, of another some were somebody else's, a third one's vectors were turned round
    before = known.where(~((person == 2) & (F.col("id") % 2 == 0))).withColumns({"person_id": F.when((person == 5) & (F.col("id") % 3 == 0), 2).otherwise(person), "vec": F.when(person == 7, F.reverse("vec")).otherwise(F.col("vec"))})
    size = known.select(F.size("vec").alias("size")).first()
    gallery = Gallery(spark, f"{shared_folder(spark)}/gallery", size["size"] if size else 1)
    gallery.build(before)
    gallery.refresh(known)
    return _shown(I.suggestions(pending, gallery.read(), IGNORE_ID, SETTINGS))


@query("SELECT face_id, round(min(sim), 6) AS low, round(quantile_cont(sim, 0.05), 6) AS p05, round(quantile_cont(sim, 0.99), 6) AS p99, round(quantile_cont(sim, 0.995), 6) AS p995, round(max(sim), 6) AS high FROM sims GROUP BY 1", _PAIRS)
def similarity_percentiles(spark, sf_dir):
    found = I.tails(*_sides(spark, sf_dir), (0.0, 0.05, 0.99, 0.995, 1.0), per_person=False)
    return found.select("face_id", *[S.rounded(F.col("p")[k]).alias(n) for k, n in enumerate(("low", "p05", "p99", "p995", "high"))])


#: Every vector is asked, against all others.
_DISTANCES_SQL = S.VECTORS_SQL + """, distances AS (SELECT a.id AS face_id, b.person_id, b.id AS gallery_id,
  sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d
  FROM vectors a, vectors b WHERE a.id <> b.id)"""


@query("SELECT face_id, arg_min(gallery_id, (round(d, 9), gallery_id)) AS gallery_id, round(min(d), 6) AS d FROM distances GROUP BY 1", _DISTANCES_SQL)
def euclid_nearest(spark, sf_dir):
    vectors = S.vectors(spark, sf_dir)
    # three of them: distances that agree to nine places are told apart by their ids
    return I.nearest_distances(vectors, vectors, 3, per_person=False).groupBy("face_id").agg(F.min_by("gallery_id", F.struct(F.round("d", 9).alias("d"), "gallery_id")).alias("gallery_id"), S.rounded(F.min("d")).alias("d"))


@query("SELECT face_id, person_id, round(avg(d), 6) AS mean_smallest FROM (SELECT *, row_number() OVER (PARTITION BY face_id, person_id ORDER BY d) AS place FROM distances) WHERE place <= 10 GROUP BY 1, 2", _DISTANCES_SQL)
def k_smallest_mean(spark, sf_dir):
    vectors = S.vectors(spark, sf_dir)
    found = I.mean_of_smallest(I.nearest_distances(vectors, vectors, 10), ("face_id", "person_id"), "d", 10)
    return found.select("face_id", "person_id", S.rounded(F.col("mean_smallest")).alias("mean_smallest"))


@query("""SELECT face_id, person_id, place, gallery_id, apart FROM (SELECT a.id AS face_id, b.declared_person_id AS person_id, b.id AS gallery_id, abs(epoch(a.taken) - epoch(b.taken)) AS apart,
  row_number() OVER (PARTITION BY a.id, b.declared_person_id ORDER BY abs(epoch(a.taken) - epoch(b.taken)), b.id) AS place
  FROM faces a, faces b WHERE a.image_id % 100 = 0 AND a.id <> b.id AND b.declared_person_id IS NOT NULL) WHERE place <= 10""", S.FACES_SQL)  # fmt: skip
def temporal_nearest(spark, sf_dir):
    """Asked are the faces of every image whose id is divisible by 100, against all other faces."""
    faces = S.faces(spark, sf_dir).withColumn("at", V.epoch_seconds(F.col("at")))
    asked = faces.where(F.col("image_id") % 100 == 0).select(F.col("id").alias("face_id"), F.col("id").alias("own_id"), "at")
    known = faces.where(F.col("declared_person_id").isNotNull()).select(F.col("declared_person_id").alias("person_id"), F.col("id").alias("gallery_id"), "at")
    return I.temporally_nearest(asked, known, 10)
