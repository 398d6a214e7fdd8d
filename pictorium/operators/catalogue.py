"""The catalogue's queries: filters, lookups, counts, nested lists and pages. All take and return DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.config import DEFAULTS, Settings
from pictorium.functions import values as V
from pictorium.operators.medians import attached, medians
from pictorium.schema import wide
from pictorium.sources.shared import written

#: Which fields each entity shows.
SUMMARY = ("id", "filename", "date_taken")
FIELDS = {
    "images": ("url", "id", "filename", "pixel_hash", "file_hash", "camera_make", "camera_model", "flash_info", "exposure_num", "exposure_denom", "focal_num", "focal_denom", "fnumber_num", "fnumber_denom", "iso_value", "light_source", "gps_lat_decimal", "gps_lon_decimal", "thumbnail_big", "thumbnail_medium", "thumbnail_small", "full_res_path", "exposure", "directory_id", "date_taken", "tags", "description", "is_processed", "date_parts", "face_set"),
    "image_summary": ("url", "filename", "thumbnail_big", "thumbnail_medium", "thumbnail_small", "directory_id"),
    "directories": ("url", "id", "dir_path", "top_level_name", "mean_datetime", "mean_datesec", "first_datetime", "first_datesec", "num_images", "year", "month", "image_set"),
    "faces": ("url", "image_id", "written_to_photo_metadata", "declared_person_id", "declared_name", *(f"{c}{k}" for k in range(1, 6) for c in ("poss_ident", "poss_name", "weight_")), "box_top", "box_bottom", "box_left", "box_right", "face_thumbnail", "rejected_ids", "validated"),
    "people": ("url", "id", "person_name", "highlight_img", "further_images_unlikely", "num_faces", "num_possibilities", "num_unverified_faces"),
}
FACE_NAMES = tuple(f"poss_name{k}" for k in range(1, 6))


def named_faces(faces: DataFrame, people: DataFrame, name: str = "declared_name") -> DataFrame:
    """Faces with the name of their declared person, null where there is none."""
    return faces.join(people.select(F.col("id").alias("declared_person_id"), F.col("person_name").alias(name)), "declared_person_id", "left")


def image_list(images: DataFrame, faces: DataFrame, people: DataFrame, *, names: Sequence[str] = (), year_from: int | None = None, year_to: int | None = None, combine: str = "or", settings: Settings = DEFAULTS) -> DataFrame:
    """Images with a listed person, or (combine) of the years, without any face of an excluded person.

    The years are asked of images that have faces, as the people are. Without either, all images stand.
    """
    if combine not in ("or", "and"):
        raise ValueError("combine must be 'or' or 'and'")
    of = lambda wanted: faces.join(F.broadcast(people.where(F.col("person_name").isin(list(wanted))).select(F.col("id").alias("declared_person_id"))), "declared_person_id", "left_semi").select(F.col("image_id").alias("id"))
    span = V.in_years(F.col("date_taken"), year_from, year_to)
    dated = year_from is not None or year_to is not None
    if names and dated and combine == "or":
        # one look at the faces: which images have any, and which have a listed one
        listed = F.broadcast(people.where(F.col("person_name").isin(list(names))).select(F.col("id").alias("declared_person_id"), F.lit(True).alias("hit")))
        seen = faces.join(listed, "declared_person_id", "left").groupBy(F.col("image_id").alias("id")).agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))
        chosen = images.join(seen, "id").where(F.col("hit") | span).drop("hit")
    else:
        chosen = images
        if names:
            chosen = chosen.join(of(names), "id", "left_semi")
        if dated:
            chosen = chosen.where(span)
            if not names:
                chosen = chosen.join(faces.select(F.col("image_id").alias("id")), "id", "left_semi")
    if settings.excluded_names:
        chosen = chosen.join(of(settings.excluded_names), "id", "left_anti")
    return chosen


def images_with_all(images: DataFrame, faces: DataFrame, people: DataFrame, names: Sequence[str], year: int | None = None) -> DataFrame:
    """Images that show every one of the people, in a year if given."""
    wanted = F.broadcast(people.where(F.col("person_name").isin(list(names))).select(F.col("id").alias("declared_person_id")))
    full = faces.join(wanted, "declared_person_id").groupBy(F.col("image_id").alias("id")).agg(F.count_distinct("declared_person_id").alias("n")).where(F.col("n") == len(set(names)))
    return (images if year is None else images.where(V.in_years(F.col("date_taken"), year, year))).join(full.select("id"), "id", "left_semi")


def declared_faces(faces: DataFrame, person_id: int, *, only_unverified: bool = False) -> DataFrame:
    found = faces.where(F.col("declared_person_id") == person_id)
    return found.where(~F.col("validated")) if only_unverified else found


def suggested_faces(faces: DataFrame, person_id: int, slot: int = 1) -> DataFrame:
    """Faces with the person in a slot of their candidates, with that weight; heaviest first."""
    place = F.get("candidates", F.lit(slot - 1))
    return faces.where(place["person_id"] == person_id).withColumn("weight", place["weight"]).orderBy(F.desc("weight"), "id")


def person_list(people: DataFrame, faces: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """People with face counts; the unassigned person's come from a live count."""
    live = faces.groupBy(F.col("declared_person_id").alias("id")).agg(F.count(F.lit(1)).alias("live"), F.count_if(~F.col("validated")).alias("live_unverified"))
    own = F.col("person_name") == settings.ignored_names[0]
    merged = people.join(live, "id", "left")
    n = F.coalesce("live", F.lit(0))
    pick = lambda c: F.when(own, n).otherwise(F.col(c).cast("long")).alias(c)
    return merged.select("id", "person_name", pick("num_faces"), pick("num_possibilities"), pick("num_unverified_faces"), V.url("/api/keyed_image/face_highlight/?id=", F.col("id").cast("string"), "&name=", F.col("person_name")).alias("url"))


def folder_list(directories: DataFrame) -> DataFrame:
    moment = F.timestamp_seconds(F.col("first_datesec"))
    return directories.select("id", "dir_path", V.leaf(F.col("dir_path")).alias("top_level_name"), F.year(moment).alias("year"), F.month(moment).alias("month"), "num_images")


def page(rows: DataFrame, offset: int = 0, size: int = DEFAULTS.page_size, order: Sequence[str] = ("id",)) -> DataFrame:
    """A page in the order of the keys; a key with a minus sign runs down. The id breaks ties."""
    keys = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in order]
    if "id" not in [k.lstrip("-") for k in order]:
        keys.append(F.asc("id"))
    return rows.orderBy(*keys).offset(offset).limit(size)


def counted_page(rows: DataFrame, offset: int = 0, size: int = DEFAULTS.page_size, order: Sequence[str] = ("id",)) -> DataFrame:
    """A page, each row with `total`, the number of all rows, and whether there is a page before and after it."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = page(rows, offset, size, order).join(F.broadcast(total))  # one row
    return out.withColumn("has_previous", F.lit(offset > 0)).withColumn("has_next", F.col("total") > offset + size)


def first_and_last(rows: DataFrame, value: str) -> DataFrame:
    """One row: ids of the first and last row by falling value (ties by id), and whether the first value is no less."""
    high, low = F.struct(F.col(value).alias("v"), (-F.col("id")).alias("i")), F.struct(F.col(value).alias("v"), (-F.col("id")).alias("i"))
    found = rows.agg(F.max(high).alias("first"), F.min(low).alias("last"))
    return found.select((-F.col("first.i")).alias("first_id"), (-F.col("last.i")).alias("last_id"), (F.col("first.v") >= F.col("last.v")).alias("in_order"))


def ordered(rows: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    if key.lstrip("-") not in allowed:
        raise ValueError(f"can't be ordered by {key}")
    return rows.orderBy(F.desc(key[1:]) if key.startswith("-") else F.asc(key), F.asc("id"))


def shown(rows: DataFrame, entity: str) -> DataFrame:
    """An entity's shown fields, those that the rows have."""
    return rows.select(*[c for c in FIELDS[entity] if c in rows.columns])


def shuffled(rows: DataFrame, seed: int, n: int | None = None, *, key: str = "id") -> DataFrame:
    """All rows in an order that the seed and the rows' key fix, or n of them: each task keeps its n, so no full sort is
    needed for few. Another seed gives an unrelated order, and the layout of the rows has no say."""
    mixed = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
    return mixed if n is None else mixed.limit(n)


LOOKUPS = {
    "exact": lambda c, v: c == v,
    "icontains": lambda c, v: V.contains_any_case(c, v),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "year": lambda c, v: V.in_years(c, v, v),
    "year_gte": lambda c, v: V.in_years(c, v, None),
    "year_lte": lambda c, v: V.in_years(c, None, v),
    "in": lambda c, v: c.isin(list(v)),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def filtered(rows: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows that meet all filters, each `column` or `column__lookup` with a value."""
    for key, value in filters.items():
        column, _, lookup = key.partition("__")
        rows = rows.where(LOOKUPS[lookup or "exact"](F.col(column), value))
    return rows


def fields(rows: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Only the named columns, or all but some; unknown names are refused."""
    unknown = {*(keep or ()), *drop} - {*rows.columns}
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return rows.select(*[c for c in (rows.columns if keep is None else keep) if c not in drop])


def image_detail(images: DataFrame) -> DataFrame:
    """Images with their computed fields."""
    return images.select("*", V.date_parts(F.col("date_taken")).alias("date_parts"), V.ratio(F.col("exposure_num"), F.col("exposure_denom")).alias("exposure"))


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, columns: Sequence[str]) -> DataFrame:
    """Parents with a sorted list of their children's columns, empty where there are none."""
    lists = children.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, "id", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def children_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    counts = children.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def candidate_names(faces: DataFrame, people: DataFrame, slots: int = 5) -> DataFrame:
    """Faces with their candidates' names by slot, N/A where there is none. The names are joined to the face slot by slot, so
    no face is taken apart and gathered again; where they are broadcast, no face moves."""
    names = people.select(F.col("id").alias("_person"), "person_name")
    out = faces
    for k in range(1, slots + 1):
        name = names.withColumnRenamed("person_name", f"poss_name{k}")
        out = out.withColumn("_slot", F.get("candidates", F.lit(k - 1))["person_id"]).join(name, F.col("_slot") == F.col("_person"), "left").drop("_slot", "_person")
    return out.withColumns({f"poss_name{k}": F.coalesce(f"poss_name{k}", F.lit("N/A")) for k in range(1, slots + 1)})


def face_shown(faces: DataFrame, people: DataFrame) -> DataFrame:
    """Faces as they are shown: names, candidates by slot, and no vectors."""
    out = wide(candidate_names(named_faces(faces, people), people))
    return shown(out.withColumn("url", V.url("/api/faces/", F.col("id").cast("string"), "/")), "faces")


def image_shown(images: DataFrame, faces: DataFrame) -> DataFrame:
    """Images as they are shown, with their faces' ids."""
    out = nested(image_detail(images), faces, "image_id", "face_set", ["id"])
    return shown(out.withColumn("url", V.url("/api/images/", F.col("id").cast("string"), "/")), "images")


def candidate_cards(faces: DataFrame, people: DataFrame) -> DataFrame:
    """One row a candidate of each face: its place, name, weight and picture."""
    one = faces.select("id", F.posexplode("candidates").alias("place", "c"))
    cards = one.select("id", "place", F.col("c.person_id").alias("person_id"), F.col("c.weight").alias("weight")).join(people.select(F.col("id").alias("person_id"), "person_name"), "person_id")
    return cards.withColumn("url", V.url("/api/keyed_image/person/?id=", F.col("person_id").cast("string")))


def server_stats(images: DataFrame, faces: DataFrame, people: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: counts, shares and the hours left. Three one-row aggregates side by side; no whole, no share."""
    done = images.agg(F.count(F.lit(1)).alias("num_images"), F.count_if("is_processed").alias("num_processed"))
    tagged = V.not_in(F.col("person_name"), list(settings.ignored_names))
    named = faces.join(F.broadcast(people.select(F.col("id").alias("declared_person_id"), "person_name")), "declared_person_id", "left")
    counts = named.agg(F.count(F.lit(1)).alias("num_faces"), F.count_if(tagged).alias("num_tagged"), F.count_if(tagged & F.col("validated")).alias("num_verified"), F.count_if(F.col("person_name") == settings.ignored_names[0]).alias("num_unassigned"))
    row = done.crossJoin(counts).crossJoin(people.agg(F.count(F.lit(1)).alias("num_people")))
    return row.select("*", V.percent(F.col("num_processed"), F.col("num_images")).alias("processed_percent"), V.percent(F.col("num_verified"), F.col("num_tagged")).alias("verified_percent"), ((F.col("num_images") - F.col("num_processed")) / settings.images_per_hour).alias("hours_left"))


def confident_unassigned(faces: DataFrame, unassigned_id: int, least: float) -> DataFrame:
    """Unassigned faces whose first candidate is heavy enough, heaviest first."""
    weight = F.get("candidates", F.lit(0))["weight"]
    found = faces.where((F.col("declared_person_id") == unassigned_id) & (weight > least))
    return found.select("id", weight.alias("weight")).orderBy(F.desc("weight"), "id")


def people_with_more(people: DataFrame, faces: DataFrame, more_than: int, settings: Settings = DEFAULTS) -> DataFrame:
    """People, but for the ignored ones, with more than so many declared faces."""
    counts = faces.groupBy(F.col("declared_person_id").alias("id")).agg(F.count(F.lit(1)).alias("n_faces")).where(F.col("n_faces") > more_than)
    return people.where(~F.col("person_name").isin(list(settings.ignored_names))).join(counts, "id")


def counters(people: DataFrame, faces: DataFrame) -> DataFrame:
    """Each person's counts from the faces: declared, unverified, first candidate, and candidate in any slot."""
    declared = faces.groupBy(F.col("declared_person_id").alias("id")).agg(F.count(F.lit(1)).alias("num_faces"), F.count_if(~F.col("validated")).alias("num_unverified_faces"))
    places = faces.select(F.posexplode("candidates").alias("place", "c")).groupBy(F.col("c.person_id").alias("id")).agg(F.count_if(F.col("place") == 0).alias("num_possibilities"), F.count(F.lit(1)).alias("num_possibilities_any"))
    out = people.select("id", "person_name").join(declared, "id", "left").join(places, "id", "left")
    return out.na.fill(0)


def with_directory(images: DataFrame, directories: DataFrame, *, by_path: bool = False) -> DataFrame:
    """Images with their directory's path (`dir_path`), by its id or by the path of the file."""
    of = directories.select(F.col("id").alias("directory_id"), "dir_path")
    if by_path:
        return images.drop("directory_id").withColumn("dir_path", V.parent(F.col("filename"))).join(of, "dir_path", "left")
    return images.join(of, "directory_id", "left")


def keyed_path(images: DataFrame, faces: DataFrame, people: DataFrame, kind: str) -> DataFrame:
    """id -> path of a picture of a kind."""
    columns = {"full_big": (images, "full_res_path"), "full_medium": (images, "thumbnail_medium"), "full_small": (images, "thumbnail_small"), "slideshow": (images, "filename"), "face_array": (faces, "face_thumbnail"), "face_source": (faces, "filename"), "face_highlight": (people, "highlight_img")}
    if kind not in columns:
        raise ValueError(f"no such kind of picture: {kind}")
    rows, column = columns[kind]
    if kind == "face_source":
        rows = rows.join(images.select(F.col("id").alias("image_id"), "filename"), "image_id")
    return rows.select("id", F.col(column).alias("path"))


def in_order(rows: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The rows of these ids, in the order given: `place` says which."""
    asked = rows.sparkSession.createDataFrame(list(enumerate(ids)), "place int, id long")
    return rows.join(F.broadcast(asked), "id").orderBy("place")


def robust_dates(images: DataFrame, *, now: float, factor: float = DEFAULTS.outlier_factor) -> DataFrame:
    """Per directory: mean and first of the valid dates that lie within `factor` median deviations of the median.

    All stay where the median deviation is 0; a directory without valid dates gets `now`. A directory with most of the
    images is no task's buffer: both its medians are found by counting.
    """
    dates = images.where("date_taken_valid").select("directory_id", V.epoch_seconds(F.col("date_taken")).alias("sec")).where("sec is not null and directory_id is not null")
    middle = written(medians(dates, "directory_id", "sec"))
    n = middle.count()
    apart = written(attached(dates, middle, "directory_id", n).withColumn("apart", F.abs(F.col("sec") - F.col("median"))).drop("median"))
    spread = written(medians(apart, "directory_id", "apart").withColumnRenamed("median", "mad"))
    kept = attached(apart, spread, "directory_id", n).where((F.col("mad") == 0) | (F.col("apart") / F.col("mad") < factor))
    found = kept.groupBy("directory_id").agg(F.avg("sec").alias("mean_datesec"), F.floor(F.min("sec")).cast("double").alias("first_datesec"), F.count(F.lit(1)).alias("n_used")).hint("merge")
    every = images.select("directory_id").distinct().join(found, "directory_id", "left")
    return every.select("directory_id", F.coalesce("mean_datesec", F.lit(now)).alias("mean_datesec"), F.coalesce("first_datesec", F.lit(now)).alias("first_datesec"), F.coalesce("n_used", F.lit(0)).alias("n_used"))


def checked(rows: DataFrame, **checks: Column) -> DataFrame:
    """Rows with the names of the checks that they fail; a null outcome fails too."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.withColumn("failed", F.array_compact(failed))
