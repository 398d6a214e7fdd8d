"""File trees, CSV lists and Parquet caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.functions import values as V


def listing(spark: SparkSession, root: str, *, contents: bool = False) -> DataFrame:
    """path, modified, length of all image files below a folder, hidden ones left out; contents on demand.

    Without `contents` that column is never read, so a listing costs no file reads.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    columns = [path.alias("path"), F.col("modificationTime").alias("modified"), F.col("length")]
    kept = files.select(*columns, *(["content"] if contents else []))
    return kept.where(V.is_image(F.col("path")) & ~V.is_hidden(F.regexp_replace("path", "^" + _quoted(root), "")))


def _quoted(root: str) -> str:
    return r"\Q" + root.removeprefix("file://").rstrip("/") + r"\E"


def contents_of(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Contents of the files in `wanted` (path) only: the listing decides first, files are read after."""
    return listing(spark, root, contents=True).join(wanted, "path", "left_semi")


def with_existence(rows: DataFrame, column: str, files: DataFrame, name: str = "exists") -> DataFrame:
    """Rows with whether the listing holds the path in a column."""
    here = files.select(F.col("path").alias(column), F.lit(True).alias(name)).distinct()
    return rows.join(here, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def append_unique(spark: SparkSession, path: str, rows: DataFrame, schema: str) -> DataFrame:
    """Adds rows to a CSV list that it doesn't hold yet, and returns those added."""
    try:
        known = read_csv(spark, path, schema)
        known.limit(1).count()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = spark.createDataFrame([], schema)
    fresh = rows.select(*known.columns).distinct().join(known, known.columns, "left_anti")
    fresh.write.mode("append").csv(path, header=True)
    return fresh


def write_sections(rows: DataFrame, path: str, size: int = 500) -> None:
    """Parquet files of at most `size` rows."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", size).parquet(path)


def write_by_person(rows: DataFrame, path: str, key: str = "person_id", parts: int = 8) -> None:
    """One folder a person. Each person's rows are gathered in at most `parts` files, so that a folder holds few and no
    single task writes a person who has most of the rows."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    rows.repartition(F.col(key), salt).write.mode("overwrite").partitionBy(key).parquet(path)


def split_valid(rows: DataFrame, **checks: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the names of what they fail."""
    from pictorium.operators.catalogue import checked

    marked = checked(rows, **checks)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def as_json(rows: DataFrame, name: str = "body") -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))
