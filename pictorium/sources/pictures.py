"""Pictures: decoding, turning, cut-outs, thumbnails, camera tags, detectors. Needs Pillow, which is optional."""

from __future__ import annotations

import functools
import io
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pictorium.functions import values as V

try:
    from PIL import Image
except ModuleNotFoundError:
    Image = None

#: How an orientation code turns a picture (Pillow's names).
TURNS = {2: "FLIP_LEFT_RIGHT", 3: "ROTATE_180", 4: "FLIP_TOP_BOTTOM", 5: "TRANSPOSE", 6: "ROTATE_270", 7: "TRANSVERSE", 8: "ROTATE_90"}
#: Numbers of camera tags, in the top directory and in the camera's own, and of the place's.
TAGS = {271: "make", 272: "model", 274: "orientation", 306: "date_time", 33434: "exposure", 33437: "fnumber", 34855: "iso_value", 36867: "date_time_original", 36868: "date_time_digitized", 37384: "light_source", 37385: "flash_info", 37386: "focal"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
#: Numbers of the directories that the top one points to.
CAMERA_DIRECTORY, PLACE_DIRECTORY = 0x8769, 0x8825
#: Greatest denominators of the numbers that are kept as fractions.
DENOMINATORS = {"exposure": 5000, "focal": 1000, "fnumber": 100}


def available() -> bool:
    return Image is not None


def opened(content: bytes, orientation: int | None):
    picture = Image.open(io.BytesIO(content))
    if picture.mode != "RGB":
        picture = picture.convert("RGB")
    turn = TURNS.get(orientation or 1)
    return picture.transpose(getattr(Image.Transpose, turn)) if turn else picture


def thumbnails(height: int) -> Callable[[Column, Column], Column]:
    """content, orientation -> JPEG of that height."""

    @F.pandas_udf("binary")
    def shrink(contents: pd.Series, orientations: pd.Series) -> pd.Series:
        def one(content: bytes, orientation: int | None) -> bytes | None:
            if content is None:
                return None
            picture = opened(content, orientation)
            picture = picture.resize((max(1, int(picture.width / picture.height * height)), height), Image.Resampling.LANCZOS)
            out = io.BytesIO()
            picture.save(out, "JPEG")
            return out.getvalue()

        return pd.Series([one(c, o) for c, o in zip(contents, orientations, strict=True)])

    return shrink


def merged_tags(found) -> dict[str, str]:
    """Known tags of the top directory, the camera's and the place's, as text; numbers of a list parted by blanks.

    found: what Pillow's getexif() gives, or another mapping with get_ifd.
    """
    shown = lambda v: " ".join(str(float(x)) for x in v) if isinstance(v, tuple | list) else v.decode("latin-1") if isinstance(v, bytes) else str(v)
    tags = {**dict(found.items()), **found.get_ifd(CAMERA_DIRECTORY)}
    out = {name: shown(tags[number]) for number, name in TAGS.items() if number in tags}
    place = found.get_ifd(PLACE_DIRECTORY)
    return out | {name: shown(place[number]) for number, name in GPS_TAGS.items() if number in place}


def camera_tags() -> Callable[[Column], Column]:
    """content -> map of tag names to text."""

    @F.pandas_udf("map<string,string>")
    def read(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else merged_tags(Image.open(io.BytesIO(c)).getexif()) for c in contents])

    return read


def tag_columns(tags: Column) -> dict[str, Column]:
    """A map of camera tags as the columns of an image: cleaned names, numbers, fractions, place and the earliest date."""
    text = lambda name: V.cleaned(tags[name])
    out = {"camera_make": text("make"), "camera_model": text("model"), "orientation": F.coalesce(text("orientation").try_cast("int"), F.lit(1))}
    out |= {name: text(name).try_cast("int") for name in ("flash_info", "iso_value", "light_source")}
    for name, limit in DENOMINATORS.items():
        fraction = as_rational(limit)(text(name).try_cast("double"))
        out |= {f"{name}_num": fraction["num"].cast("int"), f"{name}_denom": fraction["denom"].cast("int")}
    parts = lambda name: F.transform(F.split(tags[name], " "), lambda x: x.try_cast("double"))
    lat, lon = V.gps_pair(parts("lat"), text("lat_ref"), parts("lon"), text("lon_ref"))
    taken = V.earliest(*[V.exif_date(tags[name]) for name in ("date_time", "date_time_original", "date_time_digitized")])
    return out | {"gps_lat_decimal": lat, "gps_lon_decimal": lon, "date_taken": taken, "date_taken_valid": taken.isNotNull()}


def pixel_hashes() -> Callable[[Column], Column]:
    """content -> MD5 of the decoded pixels, so that a changed tag doesn't change it."""

    @F.pandas_udf("string")
    def digest(contents: pd.Series) -> pd.Series:
        import hashlib

        return pd.Series([None if c is None else hashlib.md5(np.asarray(opened(c, None)).tobytes()).hexdigest() for c in contents])

    return digest


def detectors(load: Callable[[], Callable[[np.ndarray], list[dict]]], schema: str) -> Callable[[Column], Column]:
    """content -> detections. `load` is called once in each worker and gives what finds faces in an array of pixels."""

    @F.pandas_udf(f"array<struct<{schema}>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detect = load()
        for contents in batches:
            yield pd.Series([None if c is None else detect(np.asarray(opened(c, None))) for c in contents])

    return find


@functools.lru_cache(65_536)
def _rational(value: float, limit: int) -> tuple[int, int]:
    return Fraction(value).limit_denominator(limit).as_integer_ratio()


def as_rational(limit: int) -> Callable[[Column], Column]:
    """A number as the nearest fraction whose denominator is at most `limit`; needs no Pillow."""

    @F.pandas_udf("struct<num:long,denom:long>")
    def nearest(values: pd.Series) -> pd.DataFrame:
        # each different number once; null has the code -1, which is the last of them
        codes, different = pd.factorize(values)
        pairs = [*(_rational(float(v), limit) for v in different), (None, None)]
        columns = {name: pd.array([p[k] for p in pairs], "Int64").take(codes) for k, name in enumerate(("num", "denom"))}
        return pd.DataFrame(columns)

    return nearest
