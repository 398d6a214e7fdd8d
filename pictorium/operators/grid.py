"""Boxes of one image that overlap, for images with very many boxes, and suppression among them in rounds.

Each box lies in cells of a grid whose cells are as large as itself at least, so in four of them at most; grids double
from one level to the next. Two boxes of one level meet in a cell that both lie in, a small one and a large one in the
large one's grid, where the small one is entered too. The corner where their overlap begins lies in one cell only, and
there alone the pair is emitted, so each comes once. Boxes without an area overlap nothing.

Suppression goes in rounds: of the boxes that aren't decided yet, each one that no better one overlaps is kept, and what
those overlap goes. That is the outcome of taking them one by one from the best, and a round is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.functions.boxes import Box, area, intersection
from pictorium.sources.shared import written

#: Cells of the finest grid, and grids in all: the last one's cells are 2^20 times as wide.
FINEST, LEVELS = 16, 21


def _level(l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    size = F.greatest(r - l, b - t).cast("double")
    return F.least(F.greatest(F.ceil(F.log2(size / FINEST)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def _width() -> Column:
    """Of a cell of the row's level."""
    return F.expr(f"shiftleft({FINEST}, level)")


def entered(boxes: DataFrame, above: int) -> DataFrame:
    """Boxes (image_id, l, t, r, b and others) in the cells of their own level (`own`) and of all levels up to `above`."""
    sized = boxes.where("r > l and b > t").withColumn("at", _level(*[F.col(e) for e in "ltrb"]))
    # a box is entered above its level where there are larger ones only
    levelled = sized.withColumn("level", F.explode(F.sequence(F.col("at"), F.greatest(F.col("at"), F.lit(above)))))
    w = _width()
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / w), F.floor((F.col(b) - 1e-9) / w))
    return levelled.withColumn("x", F.explode(cells("l", "r"))).withColumn("y", F.explode(cells("t", "b"))).withColumn("own", F.col("level") == F.col("at")).drop("at")


def touching(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of an image's boxes that overlap: image_id, a_id, a_l to a_b, c_id, c_l to c_b. Both: image_id, id, l, t, r, b."""
    top = lambda rows: rows.where("r > l and b > t").agg(F.max(_level(*[F.col(e) for e in "ltrb"]))).first()[0]
    above = max(top(first) or 0, top(second) or 0)
    side = lambda rows, p: entered(rows, above).select("image_id", "level", "x", "y", F.col("own").alias(f"{p}own"), *[F.col(c).alias(f"{p}{c}") for c in ("id", "l", "t", "r", "b")])
    met = side(first, "a_").join(side(second, "c_"), ["image_id", "level", "x", "y"])
    w = _width()
    corner = (F.floor(F.greatest("a_l", "c_l") / w) == F.col("x")) & (F.floor(F.greatest("a_t", "c_t") / w) == F.col("y"))
    meets = (F.col("a_own") | F.col("c_own")) & (F.least("a_r", "c_r") > F.greatest("a_l", "c_l")) & (F.least("a_b", "c_b") > F.greatest("a_t", "c_t"))
    return met.where(meets & corner).drop("level", "x", "y", "a_own", "c_own")


def kept_in_rounds(detections: DataFrame, threshold: float) -> DataFrame:
    """image_id, det_id: what is kept when boxes are taken from the best (score, then the least id) and each one goes that
    a kept one overlaps by more than the threshold. detections: image_id, det_id, score, l, t, r, b; ids tell an image's boxes apart."""
    boxes = detections.select("image_id", F.col("det_id").alias("id"), "l", "t", "r", "b")
    pairs = touching(boxes, boxes).where("a_id <> c_id")
    shared = intersection(Box.of("a_"), Box.of("c_")).cast("double")
    close = pairs.where(shared > threshold * (area(Box.of("a_")) + area(Box.of("c_")) - shared)).select("image_id", F.col("a_id").alias("id"), F.col("c_id").alias("other"))
    rank = detections.select("image_id", F.col("det_id").alias("id"), F.struct((-F.col("score").cast("double")).alias("s"), F.col("det_id").alias("i")).alias("rank"))
    of_other = rank.select("image_id", F.col("id").alias("other"), F.col("rank").alias("other_rank"))
    # an edge from each box to every better one that overlaps it
    worse = written(close.join(rank, ["image_id", "id"]).join(of_other, ["image_id", "other"]).where("other_rank < rank").select("image_id", "id", "other"))
    kept, open_, edges = [], written(rank.select("image_id", "id")), worse
    while not open_.isEmpty():
        best = written(open_.join(edges.select("image_id", "id").distinct(), ["image_id", "id"], "left_anti"))
        kept.append(best)
        gone = edges.join(best.select("image_id", F.col("id").alias("other")), ["image_id", "other"], "left_semi").select("image_id", "id").distinct()
        gone = written(gone)
        open_ = written(open_.join(best, ["image_id", "id"], "left_anti").join(gone, ["image_id", "id"], "left_anti"))
        # what went no longer stands before others, nor needs judging
        edges = written(edges.join(open_, ["image_id", "id"], "left_semi").join(open_.select("image_id", F.col("id").alias("other")), ["image_id", "other"], "left_semi").select("image_id", "id", "other"))
    out = kept[0] if kept else rank.select("image_id", "id").limit(0)
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.select("image_id", F.col("id").alias("det_id"))
