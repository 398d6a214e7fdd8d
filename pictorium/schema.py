"""Schemas of the five tables and of the messages, and the two views of a face's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTORIES = "id long, dir_path string, mean_datetime timestamp, mean_datesec double, first_datetime timestamp, first_datesec double, num_images int"
IMAGES = (
    "id long, filename string, directory_id long, pixel_hash string, file_hash string, full_res_path string, camera_make string, "
    "camera_model string, flash_info int, exposure_num int, exposure_denom int, focal_num int, focal_denom int, fnumber_num int, "
    "fnumber_denom int, iso_value int, light_source int, gps_lat_decimal double, gps_lon_decimal double, date_added timestamp, "
    "date_modified timestamp, width int, height int, date_taken timestamp, date_taken_utc double, date_taken_valid boolean, "
    "is_processed boolean, orientation int, tags array<string>, description string"
)
DUPLICATES = "id long, filename string"
PEOPLE = (
    "id long, person_name string, highlight_img string, further_images_unlikely boolean, num_faces int, num_possibilities int, "
    "num_unverified_faces int, gender string"
)
CANDIDATES = "array<struct<person_id:bigint,weight:double>>"
FACES = (
    "id long, declared_person_id long, image_id long, date_taken_utc double, reencoded boolean, face_encoding array<double>, "
    f"face_encoding_512 array<double>, candidates {CANDIDATES}, written_to_photo_metadata boolean, rejected_ids array<bigint>, "
    "box_top int, box_bottom int, box_left int, box_right int, face_thumbnail string, validated boolean, detected_age int, "
    "detected_gender string, detected_gender_prob double, detected_age_group int, detected_age_prob double"
)
LISTING = "path string, modified timestamp, length long"
DETECTIONS = (
    "image_id long, det_id long, l int, t int, r int, b int, score double, pyr_level int, tile_no int, off_screen boolean, "
    "embedding array<double>, gender int, age int"
)
FACE_OPS = "seq long, face_id_list array<bigint>, operation string, current_person_id long"

SLOTS = 5


def no_candidates() -> Column:
    return F.array().cast(CANDIDATES)


def wide(faces: DataFrame) -> DataFrame:
    """candidates as poss_ident1..5 and weight_1..5 (null and 0.0 where there is none)."""
    return faces.withColumns(
        {f"poss_ident{k}": F.get("candidates", F.lit(k - 1))["person_id"] for k in range(1, SLOTS + 1)}
        | {f"weight_{k}": F.coalesce(F.get("candidates", F.lit(k - 1))["weight"], F.lit(0.0)) for k in range(1, SLOTS + 1)}
    ).drop("candidates")


def narrow(faces: DataFrame) -> DataFrame:
    """The five slots as an array of the ones that are filled, in order."""
    slots = F.array(*[F.struct(F.col(f"poss_ident{k}").cast("long").alias("person_id"), F.col(f"weight_{k}").cast("double").alias("weight")) for k in range(1, SLOTS + 1)])
    kept = F.filter(slots, lambda s: s["person_id"].isNotNull())
    return faces.withColumn("candidates", kept).drop(*[f"{p}{k}" for k in range(1, SLOTS + 1) for p in ("poss_ident", "weight_")])
