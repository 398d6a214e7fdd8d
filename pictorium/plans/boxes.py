"""Tiles, overlaps, suppression, matching and cut-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.functions import boxes as B
from pictorium.operators import matching as M
from pictorium.plans import stand_ins as S
from pictorium.plans.registry import query

#: Detections are faces moved a little by a rule, so that some match, some miss and some are new.
DETECTED_SQL = """detected AS (SELECT image_id, id AS det_id, CAST(l + p % 9 AS INT) AS l, CAST(t + p % 7 AS INT) AS t, CAST(r + p % 5 AS INT) AS r, CAST(b + p % 11 AS INT) AS b, (p % 100) / 100.0::DOUBLE AS score
  FROM (SELECT *, box_left AS l, box_top AS t, box_right AS r, box_bottom AS b FROM faces) WHERE n <> 3)"""
KNOWN_SQL = "known AS (SELECT image_id, id, box_left AS l, box_top AS t, box_right AS r, box_bottom AS b FROM faces WHERE n <> 5)"
_IOU = """CASE WHEN (x.r - x.l) * (x.b - x.t) + (y.r - y.l) * (y.b - y.t) - i = 0 THEN 0 ELSE i / ((x.r - x.l) * (x.b - x.t) + (y.r - y.l) * (y.b - y.t) - i) END"""
_PAIRS_SQL = f"""pairs AS (SELECT *, iou - (dx * dx + dy * dy) / (w * w + h * h + 1e-7) AS diou FROM (SELECT x.image_id, x.id AS e_id, y.det_id AS d_id,
  CAST(greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) * greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) AS DOUBLE) AS i, {_IOU} AS iou,
  (x.l + x.r - y.l - y.r) / 2.0::DOUBLE AS dx, (x.t + x.b - y.t - y.b) / 2.0::DOUBLE AS dy, CAST(greatest(x.r, y.r) - least(x.l, y.l) AS DOUBLE) AS w, CAST(greatest(x.b, y.b) - least(x.t, y.t) AS DOUBLE) AS h,
  sqrt(((abs(x.r - x.l) // 2 + x.l - abs(y.r - y.l) // 2 - y.l) ** 2 + (abs(x.b - x.t) // 2 + x.t - abs(y.b - y.t) // 2 - y.t) ** 2)::DOUBLE) AS apart FROM known x JOIN detected y ON x.image_id = y.image_id))"""
VIEWS = (S.FACES_SQL, DETECTED_SQL, KNOWN_SQL, _PAIRS_SQL)


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {"l": "box_left", "t": "box_top", "r": "box_right", "b": "box_bottom"}
    return S.faces(spark, sf_dir).select("image_id", "id", "n", "p", *[F.col(c).alias(k) for k, c in sides.items()])


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faces(spark, sf_dir).where("n <> 5").select("image_id", "id", *M.EDGES)


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = {e: (F.col(e) + F.col("p") % k).cast("int") for e, k in zip(M.EDGES, (9, 7, 5, 11), strict=True)}
    return _faces(spark, sf_dir).where("n <> 3").select("image_id", F.col("id").alias("det_id"), *[c.alias(e) for e, c in moved.items()], ((F.col("p") % 100) / 100.0).alias("score"))


@query("""SELECT id, cut, CASE cut WHEN 1 THEN 0 ELSE 1 + x * 3 + y END AS tile_no, CAST(trunc(greatest(0, x * w - CASE cut WHEN 1 THEN 0 ELSE w * 0.06::DOUBLE END)) AS INT) AS l,
  CAST(trunc(greatest(0, y * h - CASE cut WHEN 1 THEN 0 ELSE h * 0.06::DOUBLE END)) AS INT) AS t, CAST(trunc(least(width, (x + 1) * w + w * 0.06::DOUBLE)) AS INT) AS r, CAST(trunc(least(height, (y + 1) * h + h * 0.06::DOUBLE)) AS INT) AS b
  FROM (SELECT id, cut, width, height, width / cut::DOUBLE AS w, height / cut::DOUBLE AS h, unnest(range(cut)) AS x FROM images, (SELECT unnest([1, 3]) AS cut)), (SELECT unnest(range(3)) AS y) WHERE y < cut""", S.IMAGES_SQL)  # fmt: skip
def tile_grid(spark, sf_dir):
    return M.tiled(S.images(spark, sf_dir))


@query("SELECT id, CAST(box_left + 40 AS INT) AS l, CAST(box_top + 30 AS INT) AS t, CAST(box_right + 40 AS INT) AS r, CAST(box_bottom + 30 AS INT) AS b, box_left < 0 OR box_top < 0 OR box_right > 200 OR box_bottom > 170 AS off_screen FROM faces", S.FACES_SQL)
def tile_translate(spark, sf_dir):
    box, off = B.moved(B.Box.of(), B.Box(*[F.lit(v) for v in (40, 30, 240, 200)]))
    return _faces(spark, sf_dir).select("id", *[c.alias(e) for e, c in zip(M.EDGES, box, strict=True)], off.alias("off_screen"))


@query("SELECT image_id, e_id, d_id, round(diou, 6) AS diou FROM pairs", *VIEWS)
def box_diou(spark, sf_dir):
    return M.overlaps(_known(spark, sf_dir), _detected(spark, sf_dir)).select("image_id", "e_id", "d_id", S.rounded(F.col("diou")).alias("diou"))


@query("""SELECT image_id, e_id AS existing_id, d_id AS det_id, 'update' AS action FROM (SELECT *, row_number() OVER (PARTITION BY image_id, e_id ORDER BY apart, d_id) AS place FROM pairs WHERE diou >= 0.3) WHERE place = 1
  UNION ALL SELECT image_id, id, NULL, 'unmatched' FROM known k WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.image_id = k.image_id AND p.e_id = k.id AND diou >= 0.3)
  UNION ALL SELECT image_id, NULL, det_id, 'new' FROM detected d WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.image_id = d.image_id AND p.d_id = d.det_id AND diou >= 0.3)""", *VIEWS)  # fmt: skip
def box_match(spark, sf_dir):
    return M.reconciled(_known(spark, sf_dir), _detected(spark, sf_dir))


_KEPT_IOU = """greatest(least(x.r, r.r) - greatest(x.l, r.l), 0) * greatest(least(x.b, r.b) - greatest(x.t, r.t), 0)::DOUBLE"""


@query(f"""SELECT image_id, unnest(kept).det_id AS det_id FROM (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) = 1)""",
  "RECURSIVE " + S.FACES_SQL, DETECTED_SQL, "ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn FROM detected)",
  f"""folded(image_id, rn, kept) AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(det_id BIGINT, l INT, t INT, r INT, b INT)[]) FROM detected
  UNION ALL SELECT f.image_id, r.rn, CASE WHEN len(list_filter(f.kept, lambda x: {_KEPT_IOU} > 0.1 * ((x.r - x.l) * (x.b - x.t) + (r.r - r.l) * (r.b - r.t) - {_KEPT_IOU}))) > 0 THEN f.kept
  ELSE list_append(f.kept, struct_pack(det_id := CAST(r.det_id AS BIGINT), l := r.l, t := r.t, r := r.r, b := r.b)) END FROM folded f JOIN ranked r ON r.image_id = f.image_id AND r.rn = f.rn + 1)""")  # fmt: skip
def nms(spark, sf_dir):
    return M.non_maximum(_detected(spark, sf_dir), 0.1)


@query("""SELECT x.image_id, x.id AS a_id, y.id AS c_id, round(CASE WHEN (x.r - x.l) * (x.b - x.t) <> 0 THEN CAST(greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) * greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) AS DOUBLE) / ((x.r - x.l) * (x.b - x.t)) END, 6) AS inside
  FROM known x JOIN known y ON x.image_id = y.image_id AND x.id <> y.id""", S.FACES_SQL, KNOWN_SQL)  # fmt: skip
def box_containment(spark, sf_dir):
    return M.containment(_known(spark, sf_dir)).withColumn("inside", S.rounded(F.col("inside")))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faces(spark, sf_dir).withColumns({"width": F.lit(320), "height": F.lit(260)})


_CLIPPED_SQL = "clipped AS (SELECT id, greatest(box_left, 0) AS l, greatest(box_top, 0) AS t, least(box_right, 320) AS r, least(box_bottom, 260) AS b FROM faces)"


@query("""SELECT id, CAST(greatest(cx - m, 0) AS INT) AS l, CAST(greatest(cy - m, 0) AS INT) AS t, CAST(least(cx + m, 320) AS INT) AS r, CAST(least(cy + m, 260) AS INT) AS b, CAST(greatest(m - cx, 0) AS INT) AS pad_l,
  CAST(greatest(m - cy, 0) AS INT) AS pad_t, CAST(greatest(cx + m - 320, 0) AS INT) AS pad_r, CAST(greatest(cy + m - 260, 0) AS INT) AS pad_b FROM (SELECT id, cx, cy, greatest(least(big * 2 // 2, cx, 320 - cx, cy, 260 - cy), big // 2) AS m
  FROM (SELECT id, (r - l) // 2 + l AS cx, (b - t) // 2 + t AS cy, greatest(r - l, b - t) AS big FROM clipped))""", S.FACES_SQL, _CLIPPED_SQL)  # fmt: skip
def square_thumb_bounds(spark, sf_dir):
    return _sized(spark, sf_dir).select("id", B.square_thumbnail(B.Box.of(), F.col("width"), F.col("height")).alias("x")).select("id", "x.*")


@query("""SELECT id, CAST(cx - e AS INT) AS l, CAST(cy - e AS INT) AS t, CAST(cx + e AS INT) AS r, CAST(cy + e AS INT) AS b FROM (SELECT id, box_left + (box_right - box_left) // 2 AS cx, box_top + (box_bottom - box_top) // 2 AS cy,
  least(box_bottom - box_top, box_right - box_left) // 2 AS e FROM faces)""", S.FACES_SQL)  # fmt: skip
def highlight_bounds(spark, sf_dir):
    return _faces(spark, sf_dir).select("id", B.square_highlight(B.Box.of()).alias("x")).select("id", "x.*")


@query("""SELECT id, cl AS chip_l, ct AS chip_t, cr AS chip_r, cb AS chip_b, CAST(trunc((l - cl) * s) AS INT) AS box_l, CAST(trunc((t - ct) * s) AS INT) AS box_t, CAST(trunc((r - cl) * s) AS INT) AS box_r, CAST(trunc((b - ct) * s) AS INT) AS box_b,
  CAST(trunc((cr - cl) * s) AS INT) AS out_w, CAST(trunc((cb - ct) * s) AS INT) AS out_h FROM (SELECT *, CASE WHEN greatest(cr - cl, cb - ct) > 60 THEN 60.0::DOUBLE / greatest(cr - cl, cb - ct) ELSE 1.0::DOUBLE END AS s FROM (SELECT *,
  CAST(trunc(greatest(l - (r - l) * 0.4::DOUBLE, 0)) AS INT) AS cl, CAST(trunc(greatest(t - (b - t) * 0.4::DOUBLE, 0)) AS INT) AS ct, CAST(trunc(least(r + (r - l) * 0.4::DOUBLE, 320)) AS INT) AS cr, CAST(trunc(least(b + (b - t) * 0.4::DOUBLE, 260)) AS INT) AS cb
  FROM clipped WHERE r > l AND b > t))""", S.FACES_SQL, _CLIPPED_SQL)  # fmt: skip
def padded_chip_bounds(spark, sf_dir):
    chips = _sized(spark, sf_dir).select("id", B.padded_chip(B.Box.of(), F.col("width"), F.col("height"), 0.4, 60).alias("x"))
    return chips.where("x is not null").select("id", "x.*")


@query("""SELECT id, CAST(box_left - w AS INT) AS l, CAST(box_top - h AS INT) AS t, CAST(box_right + w AS INT) AS r, CAST(box_bottom + h AS INT) AS b FROM (SELECT *, least(box_left, 320 - box_right, floor((size - (box_right - box_left)) / 2)) AS w,
  least(box_top, 260 - box_bottom, floor((size - (box_bottom - box_top)) / 2)) AS h FROM (SELECT *, ceil(sqrt(2) * greatest(box_right - box_left, box_bottom - box_top)) AS size FROM faces))""", S.FACES_SQL)  # fmt: skip
def turning_chip_bounds(spark, sf_dir):
    return _sized(spark, sf_dir).select("id", B.turning_chip(B.Box.of(), F.col("width"), F.col("height")).alias("x")).select("id", "x.*")


@query("SELECT count(*) AS n, count(*) FILTER (box_left >= 0 AND box_top >= 0 AND box_left < box_right AND box_top < box_bottom AND box_right <= 320 AND box_bottom <= 260) AS n_valid FROM faces", S.FACES_SQL)
def box_checks(spark, sf_dir):
    ok = B.valid_box(B.Box.of(), F.col("width"), F.col("height"))
    return _sized(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"))
