"""Boxes of an image: suppression among detections, and matching of known boxes to detected ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pictorium.config import DEFAULTS, NO_ENCODING
from pictorium.functions.boxes import Box, area, centre_distance, distance_iou, intersection, suppressed
from pictorium.operators.grid import kept_in_rounds, touching
from pictorium.sources.shared import written

EDGES = ("l", "t", "r", "b")
#: Boxes of an image from which on it is cut into cells, rather than held as one list or joined as a whole.
MANY_BOXES = 512


def _many(*boxes: DataFrame) -> DataFrame:
    """Images with many boxes on any side: image_id."""
    found = [b.groupBy("image_id").count().where(F.col("count") > MANY_BOXES).select("image_id") for b in boxes]
    return written(reduce(DataFrame.union, found).distinct())


def tiled(images: DataFrame, cuts: tuple[int, ...] = DEFAULTS.tile_cuts, overlap: float = DEFAULTS.tile_overlap) -> DataFrame:
    from pictorium.functions.boxes import tiles

    return images.select("id", F.explode(tiles(F.col("width"), F.col("height"), cuts, overlap)).alias("tile")).select("id", "tile.*")


def non_maximum(detections: DataFrame, threshold: float = DEFAULTS.box_threshold) -> DataFrame:
    """image_id, det_id: the detections of each image that no better kept one overlaps by more than the threshold. One fold
    an image, or, of images with many boxes, rounds over the pairs that overlap: the outcome is the same."""
    many = _many(detections)
    if not many.isEmpty():
        large = kept_in_rounds(detections.join(many, "image_id", "left_semi"), threshold)
        return _folded(detections.join(many, "image_id", "left_anti"), threshold).unionByName(large)
    return _folded(detections, threshold)


def _folded(detections: DataFrame, threshold: float) -> DataFrame:
    rows = F.struct(F.col("score").cast("double").alias("score"), F.col("det_id").alias("id"), *EDGES)
    lists = detections.groupBy("image_id").agg(F.collect_list(rows).alias("boxes"))
    return lists.select("image_id", F.explode(F.transform(suppressed(F.col("boxes"), threshold), lambda x: x["id"])).alias("det_id"))


def _sided(rows: DataFrame, prefix: str, key: str) -> DataFrame:
    return rows.select("image_id", F.col(key).alias(f"{prefix}id"), *[F.col(e).alias(f"{prefix}{e}") for e in EDGES])


def overlaps(existing: DataFrame, detected: DataFrame) -> DataFrame:
    """Pairs of an image's known and detected boxes with their distance IoU; the image's key is the join's."""
    pairs = _sided(existing, "e_", "id").join(_sided(detected, "d_", "det_id"), "image_id")
    return pairs.withColumn("diou", distance_iou(Box.of("e_"), Box.of("d_")))


def _near(existing: DataFrame, detected: DataFrame, threshold: float) -> DataFrame:
    """The pairs of `overlaps` that reach the threshold. A positive one needs boxes that overlap, so images with many
    boxes compare those of common cells alone."""
    many = None if threshold <= 0 else _many(existing, detected)
    if many is None or many.isEmpty():
        return overlaps(existing, detected).where(F.col("diou") >= threshold)
    few, large = (lambda rows: rows.join(many, "image_id", "left_anti")), (lambda rows: rows.join(many, "image_id", "left_semi"))
    pairs = touching(large(existing).select("image_id", "id", *EDGES), large(detected).select("image_id", F.col("det_id").alias("id"), *EDGES))
    renamed = pairs.select("image_id", *[F.col(f"{a}{c}").alias(f"{b}{c}") for a, b in (("a_", "e_"), ("c_", "d_")) for c in ("id", *EDGES)])
    every = overlaps(few(existing), few(detected)).unionByName(renamed.withColumn("diou", distance_iou(Box.of("e_"), Box.of("d_"))))
    return every.where(F.col("diou") >= threshold)


def reconciled(existing: DataFrame, detected: DataFrame, threshold: float = DEFAULTS.box_threshold, *, exclusive: bool = False) -> DataFrame:
    """image_id, existing_id, det_id, action: update, unmatched (known only) or new (detected only).

    A known box takes the detection of the greatest overlap; where several reach the threshold, the one whose middle
    is nearest. Two known boxes may take the same detection unless `exclusive`, which leaves it to the closer match.
    """
    near = _near(existing, detected, threshold)
    order = Window.partitionBy("image_id", "e_id").orderBy("apart", "d_id")
    chosen = near.withColumn("apart", centre_distance(Box.of("e_"), Box.of("d_"))).withColumn("place", F.row_number().over(order)).where("place = 1")
    if exclusive:
        best = Window.partitionBy("image_id", "d_id").orderBy(F.desc("diou"), "e_id")
        chosen = chosen.withColumn("best", F.row_number().over(best)).where("best = 1")
    update = chosen.select("image_id", F.col("e_id").alias("existing_id"), F.col("d_id").alias("det_id"), F.lit("update").alias("action"))
    left = existing.select("image_id", F.col("id").alias("existing_id")).join(update, ["image_id", "existing_id"], "left_anti").select("image_id", "existing_id", F.lit(None).cast("long").alias("det_id"), F.lit("unmatched").alias("action"))
    new = detected.select("image_id", F.col("det_id").cast("long").alias("det_id")).join(near.select("image_id", F.col("d_id").alias("det_id")), ["image_id", "det_id"], "left_anti").select("image_id", F.lit(None).cast("long").alias("existing_id"), "det_id", F.lit("new").alias("action"))
    return update.unionByName(left).unionByName(new)


def with_matches(faces: DataFrame, detected: DataFrame, actions: DataFrame, length: int = 512) -> DataFrame:
    """Known faces after matching: updated boxes and vectors, or the sentinel vector where nothing was found."""
    got = actions.where("action = 'update'").join(detected.select("image_id", "det_id", *EDGES, "embedding"), ["image_id", "det_id"]).select(F.col("existing_id").alias("id"), *[F.col(e).alias(f"new_{e}") for e in EDGES], "embedding")
    state = faces.join(actions.where("existing_id is not null").select(F.col("existing_id").alias("id"), "action"), "id", "left").join(got, "id", "left")
    vector = F.when(F.col("action") == "update", F.col("embedding")).when(F.col("action") == "unmatched", F.array_repeat(F.lit(NO_ENCODING), length)).otherwise(F.col("face_encoding_512"))
    sides = dict(zip(EDGES, ("box_left", "box_top", "box_right", "box_bottom"), strict=True))
    columns = {side: F.coalesce(F.col(f"new_{e}"), F.greatest(F.col(side), F.lit(0))) if e in "lt" else F.coalesce(f"new_{e}", side) for e, side in sides.items()}
    return state.withColumns(columns | {"face_encoding_512": vector}).select(*faces.columns)


def containment(boxes: DataFrame) -> DataFrame:
    """Of each two boxes of an image, how much of the first lies in the second."""
    pairs = _sided(boxes, "a_", "id").join(_sided(boxes, "c_", "id"), "image_id").where("a_id <> c_id")
    return pairs.select("image_id", "a_id", "c_id", F.try_divide(intersection(Box.of("a_"), Box.of("c_")).cast("double"), area(Box.of("a_"))).alias("inside"))
