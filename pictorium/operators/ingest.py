"""Bringing the catalogue in line with a file tree: what is new, gone, changed, moved or a duplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.functions import values as V
from pictorium.sources.shared import numbered, written

#: The outcomes, by the number of the case that they settle.
ACTIONS = ("skip_missing", "skip_name", "drop_duplicate", "error_repeated", "unchanged", "touch", "replace_turned", "replace_pixels", "move", "move_first", "insert_duplicate", "insert")


def listed(listing: DataFrame) -> DataFrame:
    """Image files of a listing: by name, and in no hidden place."""
    return listing.where(V.is_image(F.col("path")) & ~V.is_hidden(F.col("path")))


def new_files(listing: DataFrame, images: DataFrame, duplicates: DataFrame) -> DataFrame:
    known = images.select(F.col("filename").alias("path"))
    return listing.join(known, "path", "left_anti").join(duplicates.select(F.col("filename").alias("path")), "path", "left_anti")


def vanished(images: DataFrame, listing: DataFrame) -> DataFrame:
    return images.join(listing.select(F.col("path").alias("filename")), "filename", "left_anti")


def modified(images: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalogued images whose file is newer than the catalogue's date."""
    return images.join(listing.select(F.col("path").alias("filename"), "modified"), "filename").where(F.col("modified") > F.col("date_modified"))


def duplicate_groups(images: DataFrame) -> DataFrame:
    """Per picture with more than one row: how many, and the least and greatest id."""
    return images.groupBy("pixel_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def decisions(files: DataFrame, images: DataFrame, duplicates: DataFrame, listing: DataFrame) -> DataFrame:
    """One action a file, as if the files had come one after another in the order of their paths.

    files: path, is_file, modified, pixel_hash, orientation. A vanished twin is given to one new file only: of the
    new files with a picture, the k-th takes the k-th vanished row (by id). Of the rest, a file that finds exactly one
    other row of its picture present, counting files before it in this batch, is a duplicate and inserted.
    """
    here = listing.select(F.col("path").alias("filename"), F.lit(True).alias("present")).distinct()
    state = images.join(here, "filename", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    at = state.groupBy("filename").agg(F.count(F.lit(1)).alias("n_same_path"), F.min("id").alias("own_id"), F.min("date_modified").alias("own_modified"), F.min("pixel_hash").alias("own_hash"), F.min("orientation").alias("own_orientation")).withColumnRenamed("filename", "path")
    twins = state.groupBy("pixel_hash").agg(F.count(F.lit(1)).alias("n_twins"), F.count_if("present").alias("n_present"))
    # pictures may be equal in great numbers (blank ones, say): turns are numbered by ranges, not by one task a picture
    lost = numbered(state.where(~F.col("present")).select("pixel_hash", "id"), ["id"], ["pixel_hash"], name="turn").select("pixel_hash", "turn", F.col("id").alias("lost_id"))
    marked = files.join(at, "path", "left").join(duplicates.select(F.col("filename").alias("path"), F.lit(True).alias("is_duplicate")).distinct(), "path", "left")
    fresh = F.col("is_file") & V.is_image(F.col("path")) & F.col("is_duplicate").isNull() & F.col("n_same_path").isNull()
    turned = numbered(marked.withColumn("fresh", F.coalesce(fresh, F.lit(False))), ["path"], ["pixel_hash", "fresh"], name="turn")
    seen = turned.join(twins, "pixel_hash", "left").na.fill(0, ["n_twins", "n_present"]).join(lost, ["pixel_hash", "turn"], "left")
    n_lost = F.col("n_twins") - F.col("n_present")
    # rows of the picture when this file's turn comes: moves don't add any, inserts of earlier files do
    rows_before = F.col("n_twins") + F.greatest(F.col("turn") - 1 - n_lost, F.lit(0))
    action = (
        F.when(~F.col("is_file"), ACTIONS[0])
        .when(~V.is_image(F.col("path")), ACTIONS[1])
        .when(F.col("is_duplicate"), ACTIONS[2])
        .when(F.col("n_same_path") > 1, ACTIONS[3])
        .when((F.col("n_same_path") == 1) & (F.col("own_modified") == F.col("modified")), ACTIONS[4])
        .when((F.col("n_same_path") == 1) & (F.col("own_hash") == F.col("pixel_hash")) & (F.col("own_orientation") == F.col("orientation")), ACTIONS[5])
        .when((F.col("n_same_path") == 1) & (F.col("own_hash") == F.col("pixel_hash")), ACTIONS[6])
        .when(F.col("n_same_path") == 1, ACTIONS[7])
        .when(F.col("lost_id").isNotNull() & (F.col("n_twins") == 1), ACTIONS[8])
        .when(F.col("lost_id").isNotNull(), ACTIONS[9])
        .when(rows_before == 1, ACTIONS[10])
        .otherwise(ACTIONS[11])
    )
    acts_on = F.when(action.isin(*ACTIONS[8:10]), F.col("lost_id")).when(action.isin(*ACTIONS[4:8]), F.col("own_id"))
    return seen.select("path", action.alias("action"), acts_on.alias("image_id"))


def new_ids(rows: DataFrame, start: int, order: tuple[str, ...]) -> DataFrame:
    """Ids after `start`, without gaps, in an order (of columns that tell rows apart) that a rerun repeats."""
    placed = numbered(rows, order, name="_number")
    return placed.withColumn("id", F.lit(start) + F.col("_number")).drop("_number")


def missing_directories(paths: DataFrame, directories: DataFrame) -> DataFrame:
    """Directories of the paths that the catalogue lacks."""
    return paths.select(V.parent(F.col("path")).alias("dir_path")).distinct().join(directories.select("dir_path"), "dir_path", "left_anti")


def applied(images: DataFrame, files: DataFrame, actions: DataFrame, directories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The image rows after the actions, and the paths that become duplicates.

    A new row has no id yet: see new_ids. Moved and new rows get the directory of their path.
    """
    full = files.join(actions, "path")
    gone = actions.where(F.col("action").isin("replace_pixels")).select(F.col("image_id").alias("id")).union(images.join(actions.where("action = 'drop_duplicate'").select(F.col("path").alias("filename")), "filename", "left_semi").select("id"))
    changes = full.where(F.col("action").isin("touch", "replace_turned", "move", "move_first")).select(F.col("image_id").alias("id"), "action", "path", F.col("modified").alias("new_modified"), F.col("orientation").alias("new_orientation"))
    old = images.join(gone, "id", "left_anti").join(changes, "id", "left")
    moved = F.col("action").isin("move", "move_first")
    where = directories.select(F.col("id").alias("new_directory"), "dir_path")
    kept = old.withColumn("dir_path", F.when(moved, V.parent(F.col("path")))).join(where, "dir_path", "left").withColumns({"filename": F.when(moved, F.col("path")).otherwise(F.col("filename")), "date_modified": F.coalesce("new_modified", "date_modified"), "orientation": F.when(F.col("action") == "replace_turned", F.col("new_orientation")).otherwise(F.col("orientation")), "is_processed": F.when(F.col("action") == "replace_turned", F.lit(False)).otherwise(F.col("is_processed")), **({"directory_id": F.when(moved, F.col("new_directory")).otherwise(F.col("directory_id"))} if "directory_id" in images.columns else {})}).select(*images.columns)
    added = full.where(F.col("action").isin("insert", "insert_duplicate", "replace_pixels")).select(F.lit(None).cast("long").alias("id"), F.col("path").alias("filename"), "pixel_hash", "orientation", F.col("modified").alias("date_modified"), F.lit(False).alias("is_processed"), V.parent(F.col("path")).alias("dir_path"))
    placed = added.join(where.withColumnRenamed("new_directory", "directory_id"), "dir_path", "left").drop("dir_path")
    return kept.unionByName(placed, allowMissingColumns=True), actions.where("action = 'insert_duplicate'").select(F.col("path").alias("filename"))


def ingested(images: DataFrame, files: DataFrame, duplicates: DataFrame, listing: DataFrame, directories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, directories and duplicates after a whole batch of files: outcomes, directories that are missing so far,
    new rows with ids after the greatest one, in the order of their paths."""
    actions = written(decisions(files, images, duplicates, listing))
    touched = actions.where(F.col("action").isin("move", "move_first", "insert", "insert_duplicate", "replace_pixels")).select("path")
    last = lambda df: df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = new_ids(missing_directories(touched, directories), last(directories), ("dir_path",))
    known = directories.unionByName(fresh, allowMissingColumns=True)
    rows, again = applied(images, files, actions, known)
    rows = written(rows)
    new = new_ids(rows.where("id is null").drop("id"), last(images), ("filename",))
    return rows.where("id is not null").unionByName(new.select(*rows.columns)), known, duplicates.unionByName(again, allowMissingColumns=True)
