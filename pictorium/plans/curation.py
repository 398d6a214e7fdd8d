"""Changes to faces and people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.functions import values as V
from pictorium.operators import catalogue as C
from pictorium.operators import curation as D
from pictorium.plans import stand_ins as S
from pictorium.plans.registry import query
from pictorium.sources.shared import shared_folder, written
from pictorium.streaming import curation as stream
from pictorium.streaming import ordering, upkeep

MARKS = D.Marks(S.UNASSIGNED, S.SOFT_IGNORE, S.HARD_IGNORE)


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: the kind of event says which operation, the user and the event which faces."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    operation = F.when(kind == "view", "verify_face").when(kind == "signup", "confirm_proposed").when(kind == "click", "close_assigned").when(kind == "purchase", "close_ignored").otherwise("close_unassigned")
    key = F.col("event_id")
    ids = F.array(F.col("user_id") * 10 + 1 + key % 7, key % 1500 * 10 + 1 + F.col("user_id") % 7)
    return e.select(key.alias("seq"), F.array_distinct(ids).alias("face_id_list"), operation.alias("operation"), (key % 10).alias("current_person_id"))


def _state(faces: DataFrame) -> DataFrame:
    return faces.select("id", "declared_person_id", "validated", F.size("candidates").cast("long").alias("n_candidates"), F.size(F.coalesce("rejected_ids", F.array().cast("array<bigint>"))).cast("long").alias("n_rejected"))


_OPS_SQL = """ops AS (SELECT event_id AS seq, unnest(list_distinct([user_id * 10 + 1 + event_id % 7, event_id % 1500 * 10 + 1 + user_id % 7])) AS id, event_id % 10 AS person,
  CASE event_type WHEN 'view' THEN 'verify_face' WHEN 'signup' THEN 'confirm_proposed' WHEN 'click' THEN 'close_assigned' WHEN 'purchase' THEN 'close_ignored' ELSE 'close_unassigned' END AS op FROM events),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM ops),
  folded(id, rn, declared, validated, cands, rejected) AS (SELECT f.id, CAST(0 AS BIGINT), f.declared_person_id, f.validated, coalesce(c.cands, []), CAST([] AS BIGINT[]) FROM faces f
    LEFT JOIN (SELECT id, list(person_id ORDER BY k) AS cands FROM candidates GROUP BY id) c ON c.id = f.id
  UNION ALL SELECT id, rn, coalesce(target, declared), CASE WHEN target IS NOT NULL THEN false WHEN op = 'verify_face' THEN true ELSE validated END,
    CASE WHEN target IS NOT NULL THEN [] WHEN op = 'close_assigned' THEN list_filter(cands, lambda x: x <> person) ELSE cands END,
    CASE WHEN op = 'close_assigned' AND list_contains(cands, person) AND NOT list_contains(rejected, person) THEN list_append(rejected, person) ELSE rejected END
    FROM (SELECT f.id, o.rn, declared, validated, cands, rejected, op, person, CASE WHEN op = 'close_unassigned' THEN 1 WHEN op = 'close_ignored' AND (coalesce(declared IN (1, 2), false) OR coalesce(cands[1] = 1, false)) THEN 2
      WHEN op = 'confirm_proposed' THEN person END AS target FROM folded f JOIN numbered o ON o.id = f.id AND o.rn = f.rn + 1))"""
_BULK = query("SELECT id, declared AS declared_person_id, validated, len(cands) AS n_candidates, len(rejected) AS n_rejected FROM folded QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1", "RECURSIVE " + S.FACES_SQL, _OPS_SQL)


@_BULK
def apply_bulk_ops(spark, sf_dir):
    return _state(D.bulk_applied(S.faces(spark, sf_dir), ops(spark, sf_dir), MARKS))


@_BULK
def stream_bulk_ops(spark, sf_dir):
    return _state(stream.replayed(spark, S.faces(spark, sf_dir), ops(spark, sf_dir), MARKS))


@_BULK
def messages_out_of_order(spark, sf_dir):
    """Messages to faces arrive in the order of a hash, every tenth twice."""
    folder = shared_folder(spark)
    sent = written(ordering.numbered_messages(ops(spark, sf_dir)).select("face_id", "nth", "operation", "person", F.pmod(F.xxhash64("face_id", "nth"), F.lit(1_000_003)).alias("arrival")))
    again = sent.where(F.col("arrival") % 10 == 0).withColumn("arrival", F.pmod(F.xxhash64("arrival", "face_id"), F.lit(1_000_003)))
    table = stream.FaceTable(spark, f"{folder}/faces")
    table.start(S.faces(spark, sf_dir))
    messages = stream.arrived(sent.unionByName(again), f"{folder}/messages", "arrival", 3)
    step = ordering.applied_in_turn(table, MARKS, f"{folder}/aside")
    query = ordering.with_rocks(spark, lambda: stream.started(ordering.in_turn(messages, 24 * 3_600_000), step, f"{folder}/checkpoint"), ends=True)
    return _state(table.read(stream.last_batch(query)))


@query("""SELECT p.id, person_name, coalesce(n, 0) AS num_faces, coalesce(u, 0) AS num_unverified_faces, coalesce(f, 0) AS num_possibilities, coalesce(e, 0) AS num_possibilities_any FROM people p
  LEFT JOIN (SELECT declared AS id, count(*) AS n, count(*) FILTER (NOT validated) AS u FROM final GROUP BY 1) d ON d.id = p.id
  LEFT JOIN (SELECT c AS id, count(*) FILTER (k = 1) AS f, count(*) AS e FROM (SELECT unnest(cands) AS c, unnest(generate_series(1, len(cands))) AS k FROM final) GROUP BY 1) c ON c.id = p.id""",
       "RECURSIVE " + S.PEOPLE_SQL, S.FACES_SQL, _OPS_SQL, "final AS (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1)")
def counters_kept_up(spark, sf_dir):
    """Counts by person after the messages came in several micro-batches, by differences alone."""
    folder = shared_folder(spark)
    table = stream.FaceTable(spark, f"{folder}/faces")
    table.start(S.faces(spark, sf_dir))
    view = upkeep.SumView(spark, f"{folder}/counts", "person_id", upkeep.PERSON_MEASURES, fold=2)
    view.start(upkeep.person_contributions(table.read(-1)))
    messages = stream.arrived(ops(spark, sf_dir), f"{folder}/ops", "seq", 4)
    last = stream.last_batch(stream.started(messages, upkeep.counted(table, view, MARKS), f"{folder}/checkpoint"))
    return upkeep.with_counts(S.people(spark, sf_dir), view.read(last))


@query("SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS k, person_id, weight FROM candidates WHERE person_id <> 5", S.FACES_SQL)
def reject_compact(spark, sf_dir):
    return S.candidate_rows(D.rejected(S.faces(spark, sf_dir), F.lit(True), 5)).select("id", F.col("k").cast("long").alias("k"), "person_id", "weight")


#: Person 5 becomes person `to` everywhere: of candidates that are one person then, the first stays.
_REPOINTED_SQL = """SELECT f.id, CASE WHEN f.declared_person_id = 5 THEN {to} ELSE f.declared_person_id END AS declared_person_id, coalesce(c.people, '') AS people, CASE WHEN f.id % 4 = 0 THEN '1,{to}' WHEN f.id % 4 = 1 THEN '{to}' END AS rejected
  FROM faces f LEFT JOIN (SELECT id, string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY k) AS people FROM (SELECT id, person_id, min(k) AS k FROM (SELECT id, k, CASE WHEN person_id = 5 THEN {to} ELSE person_id END AS person_id FROM
  (SELECT c.id, c.k, CASE WHEN c.k = 2 AND c.id % 3 = 0 THEN 5 WHEN c.k = 0 AND c.id % 3 = 0 THEN 6 ELSE c.person_id END AS person_id FROM candidates c)) GROUP BY id, person_id) GROUP BY id) c ON c.id = f.id"""


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of which some have 6 as their first and 5 as their third candidate, and some have rejected 1, 5 and 6."""
    faces, third = S.faces(spark, sf_dir), F.col("id") % 3 == 0
    person = lambda c, i: F.when(third & (i == 2), F.lit(5).cast("long")).when(third & (i == 0), F.lit(6).cast("long")).otherwise(c["person_id"])
    moved = F.transform("candidates", lambda c, i: F.struct(person(c, i).alias("person_id"), c["weight"].alias("weight")))
    longs = lambda *ids: F.array(*[F.lit(x).cast("long") for x in ids])
    return faces.withColumn("candidates", moved).withColumn("rejected_ids", F.when(F.col("id") % 4 == 0, longs(1, 5)).when(F.col("id") % 4 == 1, longs(5)))


def _mentions(faces: DataFrame) -> DataFrame:
    joined = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    return faces.select("id", "declared_person_id", joined(F.transform("candidates", lambda c: c["person_id"])).alias("people"), joined(F.col("rejected_ids")).alias("rejected"))


@query(_REPOINTED_SQL.format(to=6), S.FACES_SQL)
def merge_people(spark, sf_dir):
    return _mentions(D.people_merged(S.people(spark, sf_dir), _crowded(spark, sf_dir), 5, 6)[1])


@query(_REPOINTED_SQL.format(to=0), S.FACES_SQL)
def delete_person_revert(spark, sf_dir):
    return _mentions(D.person_deleted(S.people(spark, sf_dir), _crowded(spark, sf_dir), 5, S.UNASSIGNED)[1])


_NAMED_SQL = "named AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'Supplier#000000007' ELSE 'Tag ' || CAST(id % 12 AS VARCHAR) END AS name FROM faces)"
_ENSURED_SQL = """ensured AS (SELECT id, person_name FROM people UNION ALL SELECT (SELECT max(id) FROM people) + row_number() OVER (ORDER BY name), name FROM (SELECT DISTINCT coalesce(name, '_NO_FACE_ASSIGNED_') AS name FROM named)
  WHERE name NOT IN (SELECT person_name FROM people))"""


def _tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("id")
    name = F.when(key % 5 == 0, F.lit(None).cast("string")).when(key % 5 == 1, "Supplier#000000007").otherwise(F.concat(F.lit("Tag "), (key % 12).cast("string")))
    return D.tagged(S.faces(spark, sf_dir).withColumn("name", name), S.people(spark, sf_dir))


@query("SELECT id, person_name FROM ensured", S.PEOPLE_SQL, S.FACES_SQL, _NAMED_SQL, _ENSURED_SQL)
def tagged_people(spark, sf_dir):
    return _tagged(spark, sf_dir)[0].select("id", "person_name")


@query("SELECT n.id, e.id AS declared_person_id FROM named n JOIN ensured e ON e.person_name = coalesce(n.name, '_NO_FACE_ASSIGNED_')", S.PEOPLE_SQL, S.FACES_SQL, _NAMED_SQL, _ENSURED_SQL)
def tagged_faces(spark, sf_dir):
    return _tagged(spark, sf_dir)[1].select("id", "declared_person_id")


@query("SELECT f.id, CASE WHEN f.id = 71 THEN (SELECT max(id) + 1 FROM people) ELSE declared_person_id END AS declared_person_id, CASE WHEN f.id = 71 THEN 0 ELSE n % 6 END AS n_candidates FROM faces f", S.PEOPLE_SQL, S.FACES_SQL)
def new_person_face(spark, sf_dir):
    _, faces = D.face_to_new_person(S.people(spark, sf_dir), S.faces(spark, sf_dir), 71, "Somebody New")
    return faces.select("id", "declared_person_id", F.size("candidates").cast("long").alias("n_candidates"))


@query("SELECT id, person_name, CASE WHEN id = (SELECT declared_person_id FROM faces WHERE id = 71) OR person_name = 'Somebody New' THEN '/faces/71.jpg' END AS highlight_img FROM (SELECT id, person_name FROM people UNION ALL SELECT (SELECT max(id) + 1 FROM people), 'Somebody New' FROM faces WHERE id = 71)", S.PEOPLE_SQL, S.FACES_SQL)
def new_person_and_thumbnail(spark, sf_dir):
    """A face that isn't there makes no new person and gives nobody a picture."""
    picture = F.concat(F.lit("/faces/"), F.col("id").cast("string"), F.lit(".jpg"))
    faces = S.faces(spark, sf_dir)
    people = D.thumbnail_set(S.people(spark, sf_dir), faces, 71, picture)
    return D.face_to_new_person(people, faces, 71, "Somebody New", picture)[0].select("id", "person_name", "highlight_img")


@query("SELECT coalesce(refused, '') AS refused, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('view', 'error') AND event_id % 9 = 0 THEN 'no such operation' WHEN event_id % 7 = 0 THEN 'no faces' WHEN event_type IN ('signup', 'click') AND event_id % 5 = 0 THEN 'no person' END AS refused FROM events) GROUP BY 1")
def refused_messages(spark, sf_dir):
    key = F.col("seq")
    messages = ops(spark, sf_dir).withColumns({"operation": F.when(F.col("operation").isin("verify_face", "close_unassigned") & (key % 9 == 0), "nonsense").otherwise(F.col("operation")), "face_id_list": F.when(key % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.col("face_id_list")), "current_person_id": F.when(key % 5 != 0, F.col("current_person_id"))})
    return D.refusals(messages).groupBy(F.coalesce("refused", F.lit("")).alias("refused")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, 0 AS n_candidates FROM faces", S.FACES_SQL)
def reset_suggestions(spark, sf_dir):
    return D.suggestions_reset(S.faces(spark, sf_dir), S.UNASSIGNED).select("id", F.size("candidates").cast("int").alias("n_candidates"))


@query("SELECT id, CASE WHEN declared_person_id = 0 THEN n % 6 ELSE 0 END AS n_candidates FROM faces", S.FACES_SQL)
def clear_candidates_assigned(spark, sf_dir):
    faces = D.assigned_cleared(S.faces(spark, sf_dir), S.UNASSIGNED)
    return faces.select("id", F.greatest(F.size("candidates"), F.lit(0)).cast("long").alias("n_candidates"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 4 ELSE declared_person_id END AS declared_person_id, CASE WHEN id % 3 = 0 THEN false ELSE validated END AS validated FROM faces", S.FACES_SQL)
def associate_person(spark, sf_dir):
    return D.associated(S.faces(spark, sf_dir), F.col("id") % 3 == 0, 4).select("id", "declared_person_id", "validated")


@query("SELECT id, validated OR id % 4 = 1 AS validated FROM faces", S.FACES_SQL)
def verify_faces(spark, sf_dir):
    return D.verified(S.faces(spark, sf_dir), F.col("id") % 4 == 1).select("id", "validated")


@query("SELECT id, CASE WHEN id % 4 = 1 THEN 0 ELSE declared_person_id END AS declared_person_id FROM faces", S.FACES_SQL)
def clear_person(spark, sf_dir):
    return D.cleared(S.faces(spark, sf_dir), F.col("id") % 4 == 1, S.UNASSIGNED).select("id", "declared_person_id")


@query("SELECT id, CASE id WHEN 7 THEN 'New name' ELSE person_name END AS person_name, CASE id WHEN 7 THEN NOT further_images_unlikely ELSE further_images_unlikely END AS further_images_unlikely FROM people", S.PEOPLE_SQL)
def rename_and_toggle(spark, sf_dir):
    return D.flag_toggled(D.person_renamed(S.people(spark, sf_dir), 7, "New name"), 7).select("id", "person_name", "further_images_unlikely")


@query("SELECT id, is_processed AND directory_id <> 7 AS is_processed FROM images", S.IMAGES_SQL)
def reset_processed(spark, sf_dir):
    return D.marked_processed(S.images(spark, sf_dir), F.col("directory_id") == 7, False).select("id", "is_processed")


@query("SELECT id, image_id FROM faces WHERE image_id % 9 <> 0", S.FACES_SQL)
def delete_images_cascade(spark, sf_dir):
    images = S.images(spark, sf_dir)
    _, faces = D.images_deleted(images, S.faces(spark, sf_dir), images.where("id % 9 = 0").select("id"))
    return faces.select("id", "image_id")


@query("SELECT p.id, count(f.id) AS num_faces FROM people p LEFT JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN 4 ELSE declared_person_id END AS d FROM faces) f ON f.d = p.id GROUP BY p.id", S.PEOPLE_SQL, S.FACES_SQL)
def counters_after_change(spark, sf_dir):
    changed = D.associated(S.faces(spark, sf_dir), F.col("id") % 3 == 0, 4)
    return C.counters(S.people(spark, sf_dir), changed).select("id", "num_faces")


@query("SELECT id, CASE WHEN id % 4 <> 1 THEN k WHEN n % 6 = 0 THEN 0 ELSE k END AS k, person_id, weight FROM (SELECT c.id, c.k, f.n, CASE WHEN c.id % 4 = 1 AND c.k = 1 THEN 9 ELSE c.person_id END AS person_id, CASE WHEN c.id % 4 = 1 AND c.k = 1 THEN 0.5 ELSE c.weight END AS weight FROM candidates c JOIN faces f ON f.id = c.id UNION ALL SELECT id, CASE WHEN n % 6 = 0 THEN 0 ELSE 1 END, n, 9, 0.5 FROM faces WHERE id % 4 = 1 AND n % 6 < 2)", S.FACES_SQL)
def place_candidate(spark, sf_dir):
    faces = D.candidate_placed(S.faces(spark, sf_dir), F.col("id") % 4 == 1, 2, 9, 0.5)
    return S.candidate_rows(faces).select("id", "k", "person_id", "weight")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN epoch(date_taken) + 3600 ELSE epoch(date_taken) END AS sec, date_taken_valid OR id % 3 = 0 AS date_taken_valid FROM images", S.IMAGES_SQL)
def update_dates(spark, sf_dir):
    later = F.date_format(F.col("date_taken") + F.expr("INTERVAL 1 HOUR"), "yyyy:MM:dd HH:mm:ss")
    tagged = S.images(spark, sf_dir).withColumns({"a": F.when(F.col("id") % 3 == 0, later).otherwise("0000:00:00 00:00:00"), "b": F.when(F.col("id") % 6 == 0, F.lit("2030:01:01 00:00:00"))})
    return D.dates_recomputed(tagged, "a", "b").select("id", V.epoch_seconds(F.col("date_taken")).alias("sec"), "date_taken_valid")
