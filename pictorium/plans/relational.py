"""Lookups, filters, counts, pages and nested lists."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.config import DEFAULTS
from pictorium.functions import boxes as B
from pictorium.functions import values as V
from pictorium.operators import catalogue as C
from pictorium.operators.containment import Substrings, holding_all
from pictorium.operators.pages import Paged
from pictorium.plans import stand_ins as S
from pictorium.plans.registry import query
from pictorium.sources.shared import numbered

LISTED = ("Supplier#000000004", "Supplier#000000007")
EXCLUDING = replace(DEFAULTS, excluded_names=("Supplier#000000005",))
IGNORED_SQL = "('_NO_FACE_ASSIGNED_', '.ignore', '.realignore', '.another_ignore')"
_LIST_SQL = """SELECT i.id, i.filename, i.date_taken FROM images i WHERE {chosen}
  AND NOT EXISTS (SELECT 1 FROM face_rows f JOIN people p ON p.id = f.declared_person_id WHERE f.image_id = i.id AND p.person_name = 'Supplier#000000005')"""
_SHOWS = "EXISTS (SELECT 1 FROM face_rows f JOIN people p ON p.id = f.declared_person_id WHERE f.image_id = i.id AND p.person_name IN ('Supplier#000000004', 'Supplier#000000007'))"
_ANY_FACE = "EXISTS (SELECT 1 FROM face_rows f WHERE f.image_id = i.id)"


def _listed(spark: SparkSession, sf_dir: str, combine: str) -> DataFrame:
    found = C.image_list(S.images(spark, sf_dir), S.face_rows(spark, sf_dir), S.people(spark, sf_dir), names=LISTED, year_from=1996, year_to=1997, combine=combine, settings=EXCLUDING)
    return found.select(*C.SUMMARY)


@query(_LIST_SQL.format(chosen=f"({_SHOWS} OR (year(i.date_taken) BETWEEN 1996 AND 1997 AND {_ANY_FACE}))"), S.IMAGES_SQL, S.PEOPLE_SQL, S.FACE_ROWS_SQL)
def image_list(spark, sf_dir):
    return _listed(spark, sf_dir, "or")


@query(_LIST_SQL.format(chosen=f"{_SHOWS} AND year(i.date_taken) BETWEEN 1996 AND 1997"), S.IMAGES_SQL, S.PEOPLE_SQL, S.FACE_ROWS_SQL)
def image_list_and(spark, sf_dir):
    return _listed(spark, sf_dir, "and")


@query("SELECT i.id, i.filename FROM images i WHERE year(date_taken) = 1996 AND (SELECT count(DISTINCT f.declared_person_id) FROM faces f JOIN people p ON p.id = f.declared_person_id WHERE f.image_id = i.id AND p.person_name IN ('Supplier#000000004', 'Supplier#000000007')) = 2", S.IMAGES_SQL, S.PEOPLE_SQL, S.FACES_SQL)
def all_people_in_year(spark, sf_dir):
    return C.images_with_all(S.images(spark, sf_dir), S.faces(spark, sf_dir), S.people(spark, sf_dir), LISTED, 1996).select("id", "filename")


@query("SELECT id FROM faces WHERE declared_person_id = 4", S.FACES_SQL)
def face_declared_ids(spark, sf_dir):
    return C.declared_faces(S.faces(spark, sf_dir), 4).select("id")


@query("SELECT id FROM faces WHERE declared_person_id = 4 AND NOT validated", S.FACES_SQL)
def face_declared_unverified(spark, sf_dir):
    return C.declared_faces(S.faces(spark, sf_dir), 4, only_unverified=True).select("id")


@query("SELECT id, weight FROM candidates WHERE person_id = 5 AND k = 0 ORDER BY weight DESC, id", S.FACES_SQL)
def face_poss_ranked(spark, sf_dir):
    return C.suggested_faces(S.faces(spark, sf_dir), 5).select("id", "weight")


@query("SELECT id FROM images WHERE directory_id = 7", S.IMAGES_SQL)
def directory_images(spark, sf_dir):
    return S.images(spark, sf_dir).where(F.col("directory_id") == 7).select("id")


@query("""SELECT p.id, person_name, CASE WHEN p.id = 0 THEN n ELSE num_faces END AS num_faces, CASE WHEN p.id = 0 THEN n ELSE num_possibilities END AS num_possibilities,
  CASE WHEN p.id = 0 THEN n ELSE num_unverified_faces END AS num_unverified_faces,
  '/api/keyed_image/face_highlight/?id=' || CAST(p.id AS VARCHAR) || '&name=' || replace(person_name, ' ', '%20') AS url
  FROM people p, (SELECT count(*) AS n FROM face_rows WHERE declared_person_id = 0)""", S.PEOPLE_SQL, S.FACE_ROWS_SQL)  # fmt: skip
def person_list(spark, sf_dir):
    return C.person_list(S.people(spark, sf_dir), S.face_rows(spark, sf_dir))


@query("""SELECT id, dir_path, split_part(dir_path, '/', -1) AS top_level_name, year(make_timestamp(CAST(floor(first_datesec * 1000000) AS BIGINT))) AS year,
  month(make_timestamp(CAST(floor(first_datesec * 1000000) AS BIGINT))) AS month, num_images FROM directories""", S.DIRECTORIES_SQL)  # fmt: skip
def folder_list(spark, sf_dir):
    return C.folder_list(S.directories(spark, sf_dir))


@query("SELECT id, filename FROM images WHERE contains(lower(filename), 'urgent') ORDER BY filename, id LIMIT 50 OFFSET 100", S.IMAGES_SQL)
def images_page(spark, sf_dir):
    return C.page(C.filtered(S.images(spark, sf_dir), {"filename__icontains": "UrGent"}), 100, 50, ("filename",)).select("id", "filename")


@query("SELECT id, dir_path, num_images FROM directories WHERE contains(lower(dir_path), 'build') AND first_datesec >= 1e7 AND first_datesec <= 5e8", S.DIRECTORIES_SQL)
def directories_filter(spark, sf_dir):
    return C.filtered(S.directories(spark, sf_dir), {"dir_path__icontains": "Build", "first_datesec__gte": 1e7, "first_datesec__lte": 5e8}).select("id", "dir_path", "num_images")


@query(f"""SELECT f.id, {', '.join(f"coalesce(max(CASE WHEN k = {k} THEN person_name END), 'N/A') AS poss_name{k + 1}" for k in range(5))}
  FROM faces f LEFT JOIN candidates c ON c.id = f.id LEFT JOIN people p ON p.id = c.person_id GROUP BY f.id""", S.PEOPLE_SQL, S.FACES_SQL)  # fmt: skip
def faces_with_names(spark, sf_dir):
    return C.candidate_names(S.faces(spark, sf_dir), S.people(spark, sf_dir)).select("id", *C.FACE_NAMES)


@query("SELECT p.id, person_name, count(f.image_id) AS n_faces FROM people p LEFT JOIN face_rows f ON f.declared_person_id = p.id GROUP BY p.id, person_name", S.PEOPLE_SQL, S.FACE_ROWS_SQL)
def people_counts(spark, sf_dir):
    return C.children_counts(S.people(spark, sf_dir), S.face_rows(spark, sf_dir), "declared_person_id", "n_faces").select("id", "person_name", "n_faces")


@query("SELECT d.id, count(i.id) AS n_images FROM directories d LEFT JOIN images i ON i.directory_id = d.id GROUP BY d.id", S.DIRECTORIES_SQL, S.IMAGES_SQL)
def directory_image_counts(spark, sf_dir):
    return C.children_counts(S.directories(spark, sf_dir), S.images(spark, sf_dir), "directory_id", "n_images").select("id", "n_images")


_STATS_SQL = f"""SELECT *, CASE WHEN num_images > 0 THEN printf('%.2f%%', 100.0 * num_processed / num_images) END AS processed_percent,
  CASE WHEN num_tagged > 0 THEN printf('%.2f%%', 100.0 * num_verified / num_tagged) END AS verified_percent,
  (num_images - num_processed) / 1600.0::DOUBLE AS hours_left FROM
  (SELECT count(*) AS num_images, count(*) FILTER (is_processed) AS num_processed FROM images),
  (SELECT count(*) AS num_faces, count(*) FILTER (person_name IS NULL OR person_name NOT IN {IGNORED_SQL}) AS num_tagged,
   count(*) FILTER ((person_name IS NULL OR person_name NOT IN {IGNORED_SQL}) AND validated) AS num_verified,
   count(*) FILTER (person_name = '_NO_FACE_ASSIGNED_') AS num_unassigned FROM face_rows f LEFT JOIN people p ON p.id = f.declared_person_id),
  (SELECT count(*) AS num_people FROM people)"""


@query(_STATS_SQL, S.IMAGES_SQL, S.PEOPLE_SQL, S.FACE_ROWS_SQL)
def server_stats(spark, sf_dir):
    return C.server_stats(S.images(spark, sf_dir), S.face_rows(spark, sf_dir), S.people(spark, sf_dir))


@query("SELECT id, weight FROM candidates WHERE declared_person_id = 0 AND k = 0 AND weight > 0.3", S.FACES_SQL)
def confident_unlabeled(spark, sf_dir):
    return C.confident_unassigned(S.faces(spark, sf_dir), S.UNASSIGNED, 0.3)


@query("""SELECT c.id, k AS place, c.person_id, weight, person_name, '/api/keyed_image/person/?id=' || CAST(c.person_id AS VARCHAR) AS url
  FROM candidates c JOIN people p ON p.id = c.person_id WHERE c.declared_person_id = 0""", S.PEOPLE_SQL, S.FACES_SQL)  # fmt: skip
def unlabeled_instance(spark, sf_dir):
    return C.candidate_cards(C.declared_faces(S.faces(spark, sf_dir), S.UNASSIGNED), S.people(spark, sf_dir))


@query("SELECT id, person_name FROM people WHERE contains(lower(person_name), '00007')", S.PEOPLE_SQL)
def person_search(spark, sf_dir):
    return C.filtered(S.people(spark, sf_dir), {"person_name__icontains": "00007"}).select("id", "person_name")


@query("SELECT id, person_name FROM people WHERE contains(person_name, 'Supplier#')", S.PEOPLE_SQL)
def person_search_exact(spark, sf_dir):
    return C.filtered(S.people(spark, sf_dir), {"person_name__contains": "Supplier#"}).select("id", "person_name")


@query(f"SELECT p.id, person_name, count(*) AS n_faces FROM people p JOIN face_rows f ON f.declared_person_id = p.id WHERE person_name NOT IN {IGNORED_SQL} GROUP BY p.id, person_name HAVING count(*) > 540", S.PEOPLE_SQL, S.FACE_ROWS_SQL)
def people_having_gt(spark, sf_dir):
    return C.people_with_more(S.people(spark, sf_dir), S.face_rows(spark, sf_dir), 540).select("id", "person_name", "n_faces")


_COUNTERS_SQL = """SELECT p.id, person_name, coalesce(a.n, 0) AS num_faces, coalesce(a.u, 0) AS num_unverified_faces, coalesce(b.n, 0) AS num_possibilities,
  coalesce(b.e, 0) AS num_possibilities_any FROM people p LEFT JOIN (SELECT declared_person_id AS id, count(*) AS n, count(*) FILTER (NOT validated) AS u FROM faces GROUP BY 1) a ON a.id = p.id
  LEFT JOIN (SELECT person_id AS id, count(*) FILTER (k = 0) AS n, count(*) AS e FROM candidates GROUP BY 1) b ON b.id = p.id"""


@query(_COUNTERS_SQL, S.PEOPLE_SQL, S.FACES_SQL)
def counter_trueup(spark, sf_dir):
    return C.counters(S.people(spark, sf_dir), S.faces(spark, sf_dir))


@query("SELECT person_id AS id, count(*) AS num_possibilities FROM candidates GROUP BY 1", S.FACES_SQL)
def counter_reset_all(spark, sf_dir):
    found = C.counters(S.people(spark, sf_dir), S.faces(spark, sf_dir)).where(F.col("num_possibilities_any") > 0)
    return found.select("id", F.col("num_possibilities_any").alias("num_possibilities"))


@query("SELECT f.id, filename AS path FROM faces f JOIN images i ON i.id = f.image_id", S.IMAGES_SQL, S.FACES_SQL)
def keyed_image(spark, sf_dir):
    return C.keyed_path(S.images(spark, sf_dir), S.faces(spark, sf_dir), S.people(spark, sf_dir), "face_source")


_KINDS_SQL = """SELECT 'full_big' AS kind, id, '/big/' || CAST(id AS VARCHAR) AS path FROM images UNION ALL SELECT 'full_medium', id, '/medium/' || CAST(id AS VARCHAR) FROM images UNION ALL SELECT 'full_small', id, '/small/' || CAST(id AS VARCHAR) FROM images
  UNION ALL SELECT 'slideshow', id, filename FROM images UNION ALL SELECT 'face_array', id, '/faces/' || CAST(id AS VARCHAR) FROM faces UNION ALL SELECT 'face_highlight', id, '/people/' || CAST(id AS VARCHAR) FROM people"""


@query(_KINDS_SQL, S.IMAGES_SQL, S.PEOPLE_SQL, S.FACES_SQL)
def keyed_pictures(spark, sf_dir):
    place = lambda name: F.concat(F.lit(f"/{name}/"), F.col("id").cast("string"))
    images = S.images(spark, sf_dir).withColumns({"full_res_path": place("big"), "thumbnail_medium": place("medium"), "thumbnail_small": place("small")})
    faces, people = S.faces(spark, sf_dir).withColumn("face_thumbnail", place("faces")), S.people(spark, sf_dir).withColumn("highlight_img", place("people"))
    out = None
    for kind in ("full_big", "full_medium", "full_small", "slideshow", "face_array", "face_highlight"):
        rows = C.keyed_path(images, faces, people, kind).select(F.lit(kind).alias("kind"), "id", "path")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT id, filename, (SELECT count(*) FROM images WHERE contains(lower(filename), 'urgent')) AS total, true AS has_previous, (SELECT count(*) FROM images WHERE contains(lower(filename), 'urgent')) > 150 AS has_next FROM images WHERE contains(lower(filename), 'urgent') ORDER BY filename, id LIMIT 50 OFFSET 100", S.IMAGES_SQL)
def images_page_with_total(spark, sf_dir):
    return C.counted_page(C.filtered(S.images(spark, sf_dir), {"filename__icontains": "urgent"}), 100, 50, ("filename",)).select("id", "filename", "total", "has_previous", "has_next")


@query("SELECT arg_max(id, (weight, -id)) AS first_id, arg_min(id, (weight, -id)) AS last_id, max(weight) >= min(weight) AS in_order FROM candidates WHERE declared_person_id = 0 AND k = 0 AND weight > 0.3", S.FACES_SQL)
def confident_ends(spark, sf_dir):
    return C.first_and_last(C.confident_unassigned(S.faces(spark, sf_dir), S.UNASSIGNED, 0.3), "weight")


@query("SELECT i.id, dir_path FROM images i LEFT JOIN directories d ON d.id = i.directory_id", S.IMAGES_SQL, S.DIRECTORIES_SQL)
def images_with_directory(spark, sf_dir):
    return C.with_directory(S.images(spark, sf_dir), S.directories(spark, sf_dir)).select("id", "dir_path")


@query("SELECT i.id, regexp_extract(filename, '^(.*)/[^/]*$', 1) AS dir_path, d.id AS directory_id FROM images i LEFT JOIN (SELECT row_number() OVER (ORDER BY p) AS id, p FROM (SELECT DISTINCT '/photos/' || o_orderpriority AS p FROM orders)) d ON d.p = regexp_extract(filename, '^(.*)/[^/]*$', 1)", S.IMAGES_SQL)
def images_by_directory_path(spark, sf_dir):
    images = S.images(spark, sf_dir)
    folders = images.select(V.parent(F.col("filename")).alias("dir_path")).distinct()
    return C.with_directory(images, numbered(folders, ["dir_path"], name="id"), by_path=True).select("id", "dir_path", "directory_id")


@query(f"""SELECT '/api/faces/' || CAST(f.id AS VARCHAR) || '/' AS url, f.image_id, f.declared_person_id, p.person_name AS declared_name, validated, box_top, box_bottom, box_left, box_right,
  {', '.join(f"c{k}.person_id AS poss_ident{k + 1}, coalesce(p{k}.person_name, 'N/A') AS poss_name{k + 1}, coalesce(c{k}.weight, 0) AS weight_{k + 1}" for k in range(5))}
  FROM faces f LEFT JOIN people p ON p.id = f.declared_person_id {' '.join(f"LEFT JOIN candidates c{k} ON c{k}.id = f.id AND c{k}.k = {k} LEFT JOIN people p{k} ON p{k}.id = c{k}.person_id" for k in range(5))}""", S.PEOPLE_SQL, S.FACES_SQL)  # fmt: skip
def faces_shown(spark, sf_dir):
    return C.face_shown(S.faces(spark, sf_dir), S.people(spark, sf_dir)).drop("written_to_photo_metadata", "rejected_ids")


@query("""SELECT '/api/images/' || CAST(i.id AS VARCHAR) || '/' AS url, i.id, filename, pixel_hash, directory_id, date_taken, is_processed, CAST(width AS VARCHAR) || '/' || CAST(height AS VARCHAR) AS exposure, width AS exposure_num, height AS exposure_denom, coalesce(n, 0) AS n_faces
  FROM images i LEFT JOIN (SELECT image_id, count(*) AS n FROM faces GROUP BY 1) f ON f.image_id = i.id""", S.IMAGES_SQL, S.FACES_SQL)  # fmt: skip
def images_shown(spark, sf_dir):
    images = S.images(spark, sf_dir).withColumns({"exposure_num": F.col("width"), "exposure_denom": F.col("height")})
    return C.image_shown(images, S.faces(spark, sf_dir)).withColumn("n_faces", F.size("face_set").cast("long")).drop("face_set", "date_parts")


@query("SELECT person_name FROM people", S.PEOPLE_SQL)
def name_list(spark, sf_dir):
    return C.fields(S.people(spark, sf_dir), ["person_name"])


@query("SELECT id, year(date_taken) AS year, month(date_taken) AS month, day(date_taken) AS day, hour(date_taken) AS hour, minute(date_taken) AS minute, second(date_taken) AS second, CAST(width AS VARCHAR) || '/' || CAST(height AS VARCHAR) AS exposure FROM images", S.IMAGES_SQL)
def image_detail(spark, sf_dir):
    shown = S.images(spark, sf_dir).withColumns({"exposure_num": F.col("width"), "exposure_denom": F.col("height")})
    return C.image_detail(shown).select("id", "date_parts.*", "exposure")


@query("SELECT id, filename, width FROM images WHERE id = 12", S.IMAGES_SQL)
def image_by_id(spark, sf_dir):
    return C.fields(C.filtered(S.images(spark, sf_dir), {"id": 12}), ["id", "filename", "width"])


@query("SELECT i.id, x.place, x.face_id FROM images i JOIN (SELECT image_id, id AS face_id, row_number() OVER (PARTITION BY image_id ORDER BY id) - 1 AS place FROM faces) x ON x.image_id = i.id", S.IMAGES_SQL, S.FACES_SQL)
def nested_faces(spark, sf_dir):
    lists = C.nested(S.images(spark, sf_dir).select("id"), S.faces(spark, sf_dir), "image_id", "face_set", ["id"])
    return lists.select("id", F.posexplode("face_set").alias("place", "face")).select("id", F.col("place").cast("long").alias("place"), F.col("face.id").alias("face_id"))


@query("SELECT id, '{\"id\":' || CAST(id AS VARCHAR) || ',\"person_name\":\"' || person_name || '\"}' AS body FROM people", S.PEOPLE_SQL)
def json_bodies(spark, sf_dir):
    return S.people(spark, sf_dir).select("id", F.to_json(F.struct("id", "person_name")).alias("body"))


@query("SELECT place, i.id, filename FROM images i JOIN (VALUES (0, 77), (1, 3), (2, 500), (3, 41)) v(place, id) ON v.id = i.id", S.IMAGES_SQL)
def bulk_in_order(spark, sf_dir):
    return C.in_order(S.images(spark, sf_dir), [77, 3, 500, 41]).select("place", "id", "filename")


@query("SELECT id, CAST(trunc(width / height * 700) AS INT) AS width, 700 AS height FROM images", S.IMAGES_SQL)
def resize_dims(spark, sf_dir):
    return S.images(spark, sf_dir).select("id", B.resized(F.col("width"), F.col("height"), 700).alias("d")).select("id", "d.*")


@query("SELECT id, 'thumbnails_big/' || substr(pixel_hash, 1, 2) || '/' || substr(pixel_hash, 3, 1) || '/' || pixel_hash || '.jpg' AS path FROM images", S.IMAGES_SQL)
def thumbnail_paths(spark, sf_dir):
    return S.images(spark, sf_dir).select("id", V.bucketed("thumbnails_big", F.concat("pixel_hash", F.lit(".jpg"))).alias("path"))


@query("SELECT id, CASE WHEN orientation BETWEEN 5 AND 8 THEN height ELSE width END AS width, CASE WHEN orientation BETWEEN 5 AND 8 THEN width ELSE height END AS height FROM images", S.IMAGES_SQL)
def turned_sizes(spark, sf_dir):
    width, height = V.turned(F.col("width"), F.col("height"), F.col("orientation"))
    return S.images(spark, sf_dir).select("id", width.alias("width"), height.alias("height"))


@query("SELECT id, '/photos2/' || substr(filename, 9) AS filename, regexp_extract(filename, '^(.*)/[^/]*$', 1) AS parent FROM images", S.IMAGES_SQL)
def path_parts(spark, sf_dir):
    name = F.col("filename")
    return S.images(spark, sf_dir).select("id", V.re_rooted(name, "/photos/", "/photos2/").alias("filename"), V.parent(name).alias("parent"))


@query("""SELECT directory_id, coalesce(avg(sec) FILTER (ok), 1.7e9) AS mean_datesec, coalesce(floor(min(sec) FILTER (ok)), 1.7e9) AS first_datesec, count(*) FILTER (ok) AS n_used FROM (
  SELECT *, valid AND (mad = 0 OR apart / mad < 2) AS ok FROM (SELECT *, quantile_cont(apart, 0.5) OVER (PARTITION BY directory_id) AS mad FROM (
  SELECT *, abs(sec - quantile_cont(CASE WHEN valid THEN sec END, 0.5) OVER (PARTITION BY directory_id)) AS apart FROM (
  SELECT directory_id, date_taken_valid AS valid, CASE WHEN date_taken_valid THEN epoch(date_taken) END AS sec FROM images)))) GROUP BY 1""", S.IMAGES_SQL)  # fmt: skip
def directory_robust_dates(spark, sf_dir):
    return C.robust_dates(S.images(spark, sf_dir), now=1.7e9)


@query("SELECT id, filename, (SELECT count(*) FROM images) AS total, true AS has_previous, (SELECT count(*) FROM images) > 1250 AS has_next FROM images ORDER BY filename, id LIMIT 50 OFFSET 1200", S.IMAGES_SQL)
def deep_page(spark, sf_dir):
    """Page 25 of the images by name, from the ranges that hold it."""
    return Paged(S.images(spark, sf_dir).select("id", "filename"), ("filename", "id"), 5_000).page(25, 50)


@query("SELECT id, filename FROM images WHERE (filename, id) > ('/photos/3-MEDIUM/7', 0) ORDER BY filename, id LIMIT 100", S.IMAGES_SQL)
def page_after_key(spark, sf_dir):
    return Paged(S.images(spark, sf_dir).select("id", "filename"), ("filename", "id"), 5_000).after(("/photos/3-MEDIUM/7", 0), 100)


_SETS_SQL = "sets AS (SELECT DISTINCT p_partkey AS set_id, unnest([p_partkey % 97, p_size, CAST(floor(p_retailprice) AS BIGINT) % 100]) AS person_id FROM part)"


@query("SELECT s.set_id, f.image_id FROM sets s JOIN (SELECT DISTINCT image_id, declared_person_id AS person_id FROM face_rows WHERE declared_person_id IS NOT NULL) f ON f.person_id = s.person_id JOIN (SELECT set_id, count(*) AS n FROM sets GROUP BY 1) k ON k.set_id = s.set_id GROUP BY s.set_id, f.image_id, k.n HAVING count(*) = k.n", S.FACE_ROWS_SQL, _SETS_SQL)
def images_of_sets(spark, sf_dir):
    """The images that hold all people of a set, for a set of one to three people a part."""
    part, key = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    sets = part.select(key.alias("set_id"), F.explode(F.array(key % 97, F.col("p_size").cast("long"), F.floor("p_retailprice") % 100)).alias("person_id"))
    return holding_all(sets, S.face_rows(spark, sf_dir).select("image_id", F.col("declared_person_id").alias("person_id")))


@query("""SELECT needle, i.id FROM (SELECT DISTINCT needle FROM (SELECT '/' || CAST(p_partkey AS VARCHAR) || '.J' AS needle FROM part UNION ALL SELECT lower(o_orderpriority) || '/1' || CAST(o_orderkey % 40 AS VARCHAR) FROM orders UNION ALL SELECT '99')) n
  JOIN images i ON contains(lower(i.filename), lower(n.needle))""", S.IMAGES_SQL)  # fmt: skip
def substrings_found(spark, sf_dir):
    """Image paths that hold a needle, in either case, for a whole table of needles."""
    part, orders = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    needles = part.select(F.concat(F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".J")).alias("needle")).union(orders.select(F.concat(F.lower("o_orderpriority"), F.lit("/1"), (F.col("o_orderkey") % 40).cast("string")))).union(spark.range(1).select(F.lit("99")))
    return Substrings(S.images(spark, sf_dir).select("id", F.col("filename").alias("text"))).found(needles)


@query(f"""SELECT f.id, {', '.join(f"coalesce(max(CASE WHEN k = {k} THEN person_name END), 'N/A') AS poss_name{k + 1}" for k in range(5))}
  FROM (SELECT id FROM faces WHERE declared_person_id = 0 ORDER BY md5('11:' || CAST(id AS VARCHAR)), id LIMIT 1) f LEFT JOIN candidates c ON c.id = f.id LEFT JOIN people p ON p.id = c.person_id GROUP BY f.id""", S.PEOPLE_SQL, S.FACES_SQL)  # fmt: skip
def random_face(spark, sf_dir):
    one = C.shuffled(C.declared_faces(S.faces(spark, sf_dir), S.UNASSIGNED), 11, 1)
    return C.candidate_names(one, S.people(spark, sf_dir)).select("id", *C.FACE_NAMES)
