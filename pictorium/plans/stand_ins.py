"""The driver tables in the roles of the catalogue's tables, in Spark and in SQL.

suppliers are people (the first four are the ones with a meaning of their own), customers directories, orders images,
line items faces (one for each order and line number; most lines of a repeated number fall together).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.schema import CANDIDATES

UNASSIGNED, SOFT_IGNORE, HARD_IGNORE, CLASSIFIER_IGNORE = 0, 1, 2, 3

PEOPLE_SQL = """people AS (SELECT s_suppkey AS id,
  CASE s_suppkey WHEN 0 THEN '_NO_FACE_ASSIGNED_' WHEN 1 THEN '.ignore' WHEN 2 THEN '.realignore' WHEN 3 THEN '.another_ignore'
  ELSE s_name END AS person_name, s_acctbal < 0 AS further_images_unlikely, CAST(s_nationkey AS INT) AS num_faces,
  CAST(s_nationkey + 1 AS INT) AS num_possibilities, CAST(s_nationkey + 2 AS INT) AS num_unverified_faces FROM supplier)"""
DIRECTORIES_SQL = """directories AS (SELECT c_custkey AS id, '/photos/' || c_mktsegment || '/' || c_name AS dir_path,
  CAST(c_acctbal * 100000 AS DOUBLE) AS first_datesec, CAST(c_nationkey AS INT) AS num_images FROM customer)"""
IMAGES_SQL = """images AS (SELECT o_orderkey AS id, '/photos/' || o_orderpriority || '/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS filename,
  o_custkey AS directory_id, md5(CAST(o_orderkey % 9000 AS VARCHAR)) AS pixel_hash, o_orderdate AS date_taken,
  o_orderstatus <> 'P' AS date_taken_valid, o_orderstatus = 'F' AS is_processed, CAST(400 + o_orderkey % 1600 AS INT) AS width,
  CAST(300 + (o_orderkey * 7) % 1200 AS INT) AS height, CAST(1 + o_orderkey % 8 AS INT) AS orientation FROM orders)"""
LINES_SQL = """lines AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, min(l_suppkey) AS s, min(l_partkey) AS p,
  min(l_linenumber) AS n, min(l_returnflag) AS f, min(l_quantity) AS q, min(l_tax) AS tax, min(l_discount) AS disc, min(l_shipdate) AS taken
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
FACES_SQL = f"""{LINES_SQL}, faces AS (SELECT id, image_id, CASE WHEN tax < 0.08 THEN s % 10 END AS declared_person_id, f = 'A' AS validated,
  p, n, q, disc, taken, CAST(p % 300 AS INT) AS box_left, CAST(s * 7 % 200 AS INT) AS box_top,
  CAST(p % 300 + 20 + q AS INT) AS box_right, CAST(s * 7 % 200 + 20 + n * 9 AS INT) AS box_bottom FROM lines),
  candidates AS (SELECT id, declared_person_id, k, (p + 3 * k) % 10 AS person_id, round((q - k) / 100, 6) AS weight
  FROM faces, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE k < n % 6)"""
VECTORS_SQL = """vectors AS (SELECT vec_id AS id, label AS person_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    name = F.when(key == 0, "_NO_FACE_ASSIGNED_").when(key == 1, ".ignore").when(key == 2, ".realignore").when(key == 3, ".another_ignore").otherwise(F.col("s_name"))
    count = F.col("s_nationkey")
    return _read(spark, sf_dir, "supplier").select(key.alias("id"), name.alias("person_name"), (F.col("s_acctbal") < 0).alias("further_images_unlikely"), count.cast("int").alias("num_faces"), (count + 1).cast("int").alias("num_possibilities"), (count + 2).cast("int").alias("num_unverified_faces"))


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/photos/"), "c_mktsegment", F.lit("/"), "c_name").alias("dir_path"), (F.col("c_acctbal") * 100000).alias("first_datesec"), F.col("c_nationkey").cast("int").alias("num_images"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat(F.lit("/photos/"), "o_orderpriority", F.lit("/"), key.cast("string"), F.lit(".jpg")).alias("filename"), F.col("o_custkey").alias("directory_id"),
        F.md5((key % 9000).cast("string").cast("binary")).alias("pixel_hash"), F.col("o_orderdate").alias("date_taken"), (F.col("o_orderstatus") != "P").alias("date_taken_valid"),
        (F.col("o_orderstatus") == "F").alias("is_processed"), (400 + key % 1600).cast("int").alias("width"), (300 + (key * 7) % 1200).cast("int").alias("height"), (1 + key % 8).cast("int").alias("orientation"),
    )


def face_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces without ids, a row a line: for queries that ask for none. The person is the supplier itself."""
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.when(F.col("l_tax") < 0.08, F.col("l_suppkey")).alias("declared_person_id"), (F.col("l_returnflag") == "A").alias("validated"))


FACE_ROWS_SQL = """face_rows AS (SELECT l_orderkey AS image_id, CASE WHEN l_tax < 0.08 THEN l_suppkey END AS declared_person_id,
  l_returnflag = 'A' AS validated FROM lineitem)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = {"s": "l_suppkey", "p": "l_partkey", "f": "l_returnflag", "q": "l_quantity", "tax": "l_tax", "disc": "l_discount", "at": "l_shipdate"}
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(k) for k, c in least.items()])
    n, p, q, s = F.col("l_linenumber"), F.col("p"), F.col("q"), F.col("s")
    slot = lambda k: F.struct(((p + 3 * k) % 10).alias("person_id"), F.round((q - k) / 100, 6).alias("weight"))
    return lines.select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_orderkey").alias("image_id"), F.when(F.col("tax") < 0.08, s % 10).alias("declared_person_id"), (F.col("f") == "A").alias("validated"),
        F.lit(False).alias("written_to_photo_metadata"), F.lit(None).cast("array<bigint>").alias("rejected_ids"), F.slice(F.array(*[slot(k) for k in range(5)]), F.lit(1), (n % 6).cast("int")).cast(CANDIDATES).alias("candidates"),
        "p", n.alias("n"), "q", "disc", "at", (p % 300).cast("int").alias("box_left"), (s * 7 % 200).cast("int").alias("box_top"), (p % 300 + 20 + q).cast("int").alias("box_right"), (s * 7 % 200 + 20 + n * 9).cast("int").alias("box_bottom"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("person_id"), F.col("embedding").cast("array<double>").alias("vec"))


def candidate_rows(faces: DataFrame) -> DataFrame:
    """Candidates one to a row, as the SQL side has them."""
    return faces.select("id", "declared_person_id", F.posexplode("candidates").alias("k", "c")).select("id", "declared_person_id", "k", F.col("c.person_id").alias("person_id"), F.col("c.weight").alias("weight"))


def rounded(column: Column) -> Column:
    return F.round(column, 6)
