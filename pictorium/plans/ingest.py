"""File listings against the catalogue; camera dates and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.functions import values as V
from pictorium.operators import catalogue as C
from pictorium.operators import ingest as I
from pictorium.plans import stand_ins as S
from pictorium.plans.registry import query
from pictorium.sources.files import with_existence
from pictorium.sources.shared import shared_folder
from pictorium.streaming.upkeep import SumView, directory_contributions

#: Documents stand in for pictures: equal texts are equal pictures. Even ids are catalogued, all but every seventh are listed.
PICTURES_SQL = """pictures AS (SELECT doc_id AS id, '/p/' || source || '/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 11 WHEN 0 THEN '.png' WHEN 1 THEN '.JPEG' ELSE '.jpg' END AS path, md5(text) AS pixel_hash,
  CAST(1 + doc_id % 3 AS INT) AS orientation, CAST(doc_id % 4 AS DOUBLE) AS stamp FROM documents),
  catalogued AS (SELECT id, path AS filename, CASE WHEN id % 10 = 4 THEN 'other' ELSE pixel_hash END AS pixel_hash, CASE WHEN id % 10 = 6 THEN 9 ELSE orientation END AS orientation, CASE WHEN id % 5 = 1 THEN stamp - 1 WHEN id % 10 IN (2, 4, 6) THEN stamp - 2 ELSE stamp END AS date_modified FROM pictures WHERE id % 2 = 0),
  listing AS (SELECT path, stamp AS modified FROM pictures WHERE id % 7 <> 0), dupes AS (SELECT path AS filename FROM pictures WHERE id % 13 = 5)"""


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.col("doc_id")
    end = F.when(key % 11 == 0, ".png").when(key % 11 == 1, ".JPEG").otherwise(".jpg")
    return docs.select(key.alias("id"), F.concat(F.lit("/p/"), "source", F.lit("/"), key.cast("string"), end).alias("path"), F.md5(F.col("text").cast("binary")).alias("pixel_hash"), (1 + key % 3).cast("int").alias("orientation"), (key % 4).cast("double").alias("stamp"))


def _catalogued(pictures: DataFrame) -> DataFrame:
    key, stamp = F.col("id"), F.col("stamp")
    modified = F.when(key % 5 == 1, stamp - 1).when((key % 10).isin(2, 4, 6), stamp - 2).otherwise(stamp)
    return pictures.where(key % 2 == 0).select("id", F.col("path").alias("filename"), F.when(key % 10 == 4, "other").otherwise(F.col("pixel_hash")).alias("pixel_hash"), F.when(key % 10 == 6, 9).otherwise(F.col("orientation")).alias("orientation"), modified.alias("date_modified"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    pictures = _pictures(spark, sf_dir)
    return pictures, _catalogued(pictures), pictures.where("id % 7 <> 0").select("path", F.col("stamp").alias("modified")), pictures.where("id % 13 = 5").select(F.col("path").alias("filename"))


@query("SELECT path FROM listing WHERE path NOT IN (SELECT filename FROM catalogued) AND path NOT IN (SELECT filename FROM dupes)", PICTURES_SQL)
def new_files(spark, sf_dir):
    _, images, listing, dupes = _sides(spark, sf_dir)
    return I.new_files(listing, images, dupes).select("path")


@query("SELECT id, filename FROM catalogued WHERE filename NOT IN (SELECT path FROM listing)", PICTURES_SQL)
def vanished_files(spark, sf_dir):
    _, images, listing, _ = _sides(spark, sf_dir)
    return I.vanished(images, listing).select("id", "filename")


@query("SELECT c.id, filename FROM catalogued c JOIN listing l ON l.path = c.filename WHERE modified > date_modified", PICTURES_SQL)
def modified_files(spark, sf_dir):
    _, images, listing, _ = _sides(spark, sf_dir)
    return I.modified(images, listing).select("id", "filename")


@query("SELECT pixel_hash, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM pictures GROUP BY 1 HAVING count(*) > 1", PICTURES_SQL)
def duplicate_groups(spark, sf_dir):
    return I.duplicate_groups(_pictures(spark, sf_dir))


_IMAGE_SQL = r"regexp_matches(path, '\.[j|J][p|P][e|E]?[g|G]$')"
_ACTIONS_SQL = f"""SELECT path, action, CASE WHEN action IN ('move', 'move_first') THEN lost_id WHEN action IN ('unchanged', 'touch', 'replace_turned', 'replace_pixels') THEN own_id END AS image_id FROM (SELECT *,
  CASE WHEN NOT is_file THEN 'skip_missing' WHEN NOT is_image THEN 'skip_name' WHEN is_dupe THEN 'drop_duplicate' WHEN own_id IS NOT NULL AND own_modified = stamp THEN 'unchanged'
  WHEN own_id IS NOT NULL AND own_hash = pixel_hash AND own_orientation = orientation THEN 'touch' WHEN own_id IS NOT NULL AND own_hash = pixel_hash THEN 'replace_turned' WHEN own_id IS NOT NULL THEN 'replace_pixels'
  WHEN lost_id IS NOT NULL AND n_twins = 1 THEN 'move' WHEN lost_id IS NOT NULL THEN 'move_first' WHEN n_twins + greatest(turn - 1 - (n_twins - n_present), 0) = 1 THEN 'insert_duplicate' ELSE 'insert' END AS action
  FROM (SELECT m.*, coalesce(t.n_twins, 0) AS n_twins, coalesce(t.n_present, 0) AS n_present, l.lost_id FROM (SELECT *, row_number() OVER (PARTITION BY pixel_hash, is_file AND is_image AND NOT is_dupe AND own_id IS NULL ORDER BY path) AS turn
  FROM (SELECT p.*, p.id % 17 <> 3 AS is_file, {_IMAGE_SQL} AS is_image, path IN (SELECT filename FROM dupes) AS is_dupe, c.id AS own_id, c.date_modified AS own_modified, c.pixel_hash AS own_hash, c.orientation AS own_orientation
  FROM pictures p LEFT JOIN catalogued c ON c.filename = p.path)) m LEFT JOIN (SELECT pixel_hash, count(*) AS n_twins, count(*) FILTER (present) AS n_present FROM state GROUP BY 1) t ON t.pixel_hash = m.pixel_hash
  LEFT JOIN (SELECT pixel_hash, id AS lost_id, row_number() OVER (PARTITION BY pixel_hash ORDER BY id) AS turn FROM state WHERE NOT present) l ON l.pixel_hash = m.pixel_hash AND l.turn = m.turn))"""


_STATE_SQL = "state AS (SELECT *, filename IN (SELECT path FROM listing) AS present FROM catalogued)"


@query(_ACTIONS_SQL, PICTURES_SQL, _STATE_SQL)
def ingest_actions(spark, sf_dir):
    pictures, images, listing, dupes = _sides(spark, sf_dir)
    return I.decisions(_files(pictures), images, dupes, listing)


#: The catalogue before: only some of its directories are known, and every fourth row is processed.
_BEFORE_SQL = r"""dirs AS (SELECT row_number() OVER (ORDER BY dir_path) AS id, dir_path FROM (SELECT DISTINCT regexp_extract(filename, '^(.*)/[^/]*$', 1) AS dir_path FROM catalogued WHERE id % 6 = 0 AND id % 16 <> 6)),
  before AS (SELECT c.*, c.id % 4 = 0 AS is_processed, d.id AS directory_id FROM catalogued c LEFT JOIN dirs d ON d.dir_path = regexp_extract(c.filename, '^(.*)/[^/]*$', 1))"""
_AFTER_SQL = r"""touched AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir_path FROM acts WHERE action IN ('move', 'move_first', 'insert', 'insert_duplicate', 'replace_pixels')),
  every_dir AS (SELECT * FROM dirs UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM dirs) + row_number() OVER (ORDER BY dir_path), dir_path FROM touched WHERE dir_path NOT IN (SELECT dir_path FROM dirs)),
  changed AS (SELECT a.*, p.stamp, p.orientation AS new_orientation FROM acts a JOIN pictures p ON p.path = a.path),
  kept AS (SELECT b.id, CASE WHEN moved THEN m.path ELSE b.filename END AS filename, b.pixel_hash, CASE WHEN m.action = 'replace_turned' THEN m.new_orientation ELSE b.orientation END AS orientation, coalesce(m.stamp, b.date_modified) AS date_modified,
    CASE WHEN m.action = 'replace_turned' THEN false ELSE b.is_processed END AS is_processed, CASE WHEN moved THEN (SELECT id FROM every_dir e WHERE e.dir_path = regexp_extract(m.path, '^(.*)/[^/]*$', 1)) ELSE b.directory_id END AS directory_id
    FROM before b LEFT JOIN (SELECT *, action IN ('move', 'move_first') AS moved FROM changed WHERE action IN ('touch', 'replace_turned', 'move', 'move_first')) m ON m.image_id = b.id
    WHERE b.id NOT IN (SELECT image_id FROM acts WHERE action = 'replace_pixels') AND b.filename NOT IN (SELECT path FROM acts WHERE action = 'drop_duplicate')),
  added AS (SELECT (SELECT max(id) FROM catalogued) + row_number() OVER (ORDER BY p.path) AS id, p.path AS filename, p.pixel_hash, p.orientation, p.stamp AS date_modified, false AS is_processed, e.id AS directory_id
    FROM acts a JOIN pictures p ON p.path = a.path JOIN every_dir e ON e.dir_path = regexp_extract(p.path, '^(.*)/[^/]*$', 1) WHERE a.action IN ('insert', 'insert_duplicate', 'replace_pixels'))"""
_WHOLE = (PICTURES_SQL, _STATE_SQL, f"acts AS ({_ACTIONS_SQL})", _BEFORE_SQL, _AFTER_SQL)


def _files(pictures: DataFrame) -> DataFrame:
    return pictures.select("path", (F.col("id") % 17 != 3).alias("is_file"), F.col("stamp").alias("modified"), "pixel_hash", "orientation")


def _ingested(spark: SparkSession, sf_dir: str, *, with_before: bool = False) -> tuple[DataFrame, ...]:
    pictures, images, listing, dupes = _sides(spark, sf_dir)
    folder = V.parent(F.col("filename"))
    known = images.where("id % 6 = 0 and id % 16 <> 6").select(folder.alias("dir_path")).distinct()
    directories = I.new_ids(known, 0, ("dir_path",))
    before = images.withColumn("is_processed", F.col("id") % 4 == 0).withColumn("dir_path", folder).join(directories.withColumnRenamed("id", "directory_id"), "dir_path", "left").drop("dir_path")
    out = I.ingested(before, _files(pictures), dupes, listing, directories)
    return (before, out[0]) if with_before else out


@query("SELECT * FROM kept UNION ALL SELECT * FROM added", *_WHOLE)
def ingest_applied(spark, sf_dir):
    return _ingested(spark, sf_dir)[0].select("id", "filename", "pixel_hash", "orientation", "date_modified", "is_processed", "directory_id")


@query("SELECT directory_id, count(*) AS num_images, count(*) FILTER (is_processed) AS num_processed FROM (SELECT * FROM kept UNION ALL SELECT * FROM added) WHERE directory_id IS NOT NULL GROUP BY 1", *_WHOLE)
def directory_counts_kept_up(spark, sf_dir):
    """Counts by directory after an ingest, from those before it and the rows that it changed."""
    before, after = _ingested(spark, sf_dir, with_before=True)
    columns = ["id", "directory_id", "is_processed"]
    view = SumView(spark, shared_folder(spark), "directory_id", ("num_images", "num_processed"))
    view.start(directory_contributions(before))
    was, now = before.select(*columns), after.select(*columns)
    view.change(0, directory_contributions(was.exceptAll(now)), directory_contributions(now.exceptAll(was)))
    return view.read(0)


@query("SELECT id, dir_path FROM every_dir", *_WHOLE)
def ingest_directories(spark, sf_dir):
    return _ingested(spark, sf_dir)[1].select("id", "dir_path")


@query("SELECT filename FROM dupes UNION ALL SELECT path FROM acts WHERE action = 'insert_duplicate'", *_WHOLE)
def ingest_duplicates(spark, sf_dir):
    return _ingested(spark, sf_dir)[2].select("filename")


@query("SELECT path FROM pictures WHERE lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.jpeg'", PICTURES_SQL)
def suffix_filter(spark, sf_dir):
    return _pictures(spark, sf_dir).where(V.has_suffix(F.col("path"), (".jpg", ".jpeg"))).select("path")


@query("SELECT id, path, path IN (SELECT path FROM listing) AS is_there FROM pictures", PICTURES_SQL)
def files_that_exist(spark, sf_dir):
    pictures, _, listing, _ = _sides(spark, sf_dir)
    return with_existence(pictures.select("id", "path"), "path", listing, "is_there")


@query("SELECT doc_id AS id, sha256(text || CAST(n_chars AS VARCHAR) || 'x1') AS digest, md5('/p/' || CAST(doc_id AS VARCHAR)) AS name_digest FROM documents")
def content_digests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shape = F.concat(F.col("n_chars").cast("string"), F.lit("x1"))
    return docs.select(F.col("doc_id").alias("id"), V.content_hash(F.encode("text", "UTF-8"), shape).alias("digest"), F.md5(F.encode(F.concat(F.lit("/p/"), F.col("doc_id").cast("string")), "UTF-8")).alias("name_digest"))


@query(f"SELECT path FROM pictures WHERE {_IMAGE_SQL}", PICTURES_SQL)
def jpg_name_filter(spark, sf_dir):
    return _pictures(spark, sf_dir).where(V.is_image(F.col("path"))).select("path")


#: Other ways of writing a moment that the fallback reads, by the order's key.
_LOOSE_SQL = """loose AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%d %B %Y %H:%M:%S')
  WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:00') ELSE 'no date' END AS tag, o_orderdate AS taken FROM orders)"""


@query("SELECT id, CASE id % 6 WHEN 2 THEN epoch(date_trunc('day', taken)) WHEN 4 THEN epoch(taken) - 7200 WHEN 5 THEN NULL ELSE epoch(taken) END AS sec FROM loose", _LOOSE_SQL)
def loose_date_parse(spark, sf_dir):
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    kinds = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "dd MMMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    tag = F.lit("no date")
    for k, kind in enumerate(kinds):
        tag = F.when(key % 6 == k, F.date_format(at, kind)).otherwise(tag)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), V.epoch_seconds(V.exif_date(tag)).alias("sec"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso FROM orders")
def iso_dates(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), V.iso_8601(F.col("o_orderdate")).alias("iso"))


_EXIF_SQL = """exif AS (SELECT o_orderkey AS id, o_orderdate AS taken, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '0000:00:00 00:00:00' WHEN 2 THEN ' ' || strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  WHEN 4 THEN '' ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS tag FROM orders)"""


def _exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    colons, dashes = F.date_format(at, "yyyy:MM:dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    tag = F.when(key % 6 == 1, "0000:00:00 00:00:00").when(key % 6 == 2, F.concat(F.lit(" "), colons)).when(key % 6 == 3, dashes).when(key % 6 == 4, "").when(key % 6 == 5, F.concat(colons, F.lit("\0")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), at.alias("at"), tag.alias("tag"))


@query("SELECT id, CASE WHEN id % 6 IN (3, 5) THEN epoch(taken) END AS sec FROM exif", _EXIF_SQL)
def exif_date_parse(spark, sf_dir):
    return _exif(spark, sf_dir).select("id", V.epoch_seconds(V.exif_date(F.col("tag"))).alias("sec"))


@query("SELECT id, least(CASE WHEN id % 6 IN (3, 5) THEN epoch(taken) END, epoch(taken) + 86400 * (id % 3) - 86400, CASE WHEN id % 2 = 0 THEN epoch(taken) END) AS sec FROM exif", _EXIF_SQL)
def earliest_exif_date(spark, sf_dir):
    sec = V.epoch_seconds(F.col("at"))
    first = V.earliest(V.epoch_seconds(V.exif_date(F.col("tag"))), sec + 86400.0 * (F.col("id") % 3) - 86400.0, F.when(F.col("id") % 2 == 0, sec))
    return _exif(spark, sf_dir).select("id", first.alias("sec"))


@query("""SELECT id, CASE WHEN ok THEN round((d + m / 60 + s / 3600) * CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END, 6) ELSE -999 END AS lat, CASE WHEN ok THEN round((d + m / 60) * CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END, 6) ELSE -999 END AS lon
  FROM (SELECT s_suppkey AS id, s_suppkey % 7 <> 0 AS ok, CAST(s_suppkey % 90 AS DOUBLE) AS d, CAST(s_suppkey % 60 AS DOUBLE) AS m, CAST(s_suppkey * 3 % 60 AS DOUBLE) AS s FROM supplier)""")  # fmt: skip
def gps_decimal(spark, sf_dir):
    key = F.col("id")
    d, m, s = (key % 90).cast("double"), (key % 60).cast("double"), (key * 3 % 60).cast("double")
    lat = F.array(d, m, s)
    lon = F.when(key % 7 != 0, F.array(d, m, F.lit(float("nan"))))
    y, x = V.gps_pair(lat, F.when(key % 2 == 0, "N").otherwise("S"), lon, F.when(key % 3 == 0, "W").otherwise("E"))
    return S.people(spark, sf_dir).select("id", S.rounded(y).alias("lat"), S.rounded(x).alias("lon"))


@query("SELECT id, filename FROM images WHERE id % 40 = 0 OR width < 500", S.IMAGES_SQL)
def invalid_rows(spark, sf_dir):
    rows = S.images(spark, sf_dir).withColumn("lat", F.when(F.col("id") % 40 == 0, 90.0).otherwise(-999.0))
    bad = C.checked(rows, latitude=V.valid_latitude(F.col("lat")), width=F.col("width") >= 500, name=V.is_image(F.col("filename")))
    return bad.where(F.size("failed") > 0).select("id", "filename")
