"""Strings, paths, dates and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pictorium.config import NO_GPS

#: Fixed value: names of image files. The classes hold a literal bar, so `.|pg` counts.
IMAGE_NAME = r"\.[j|J][p|P][e|E]?[g|G]$"


def is_image(name: Column) -> Column:
    return name.rlike(IMAGE_NAME)


def has_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether the name, in lower case, ends in one of the suffixes."""
    low = F.lower(name)
    out = F.lit(False)
    for suffix in suffixes:
        out |= F.endswith(low, F.lit(suffix))
    return out


def is_hidden(path: Column) -> Column:
    """Whether any part of the path begins with a dot."""
    return path.rlike(r"(^|/)\.")


def not_in(column: Column, values: list) -> Column:
    """NOT IN that is true for null, as the negation of a lookup over a nullable key."""
    return ~F.coalesce(column.isin(list(values)), F.lit(False))


def contains_any_case(column: Column, part: str) -> Column:
    return F.contains(F.lower(column), F.lit(part.lower()))


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def re_rooted(path: Column, old: str, new: str) -> Column:
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1_000_000))).otherwise(path)


def url(*parts: Column | str) -> Column:
    """The parts joined, with spaces escaped."""
    return F.replace(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(" "), F.lit("%20"))


def bucketed(prefix: str, name: Column) -> Column:
    """prefix/ab/c/name: files spread by the first three characters of their names."""
    return F.concat_ws("/", F.lit(prefix), F.substring(name, 1, 2), F.substring(name, 3, 1), name)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.concat_ws("/", numerator.cast("string"), denominator.cast("string"))


def percent(part: Column, whole: Column) -> Column:
    """`12.34%`; null where there is no whole."""
    return F.when(whole != 0, F.format_string("%.2f%%", F.lit(100.0) * part / whole))


def cleaned(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("\0"), F.lit("")))


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970 of a timestamp's own clock reading, whatever the session's time zone."""
    return F.datediff(F.to_date(moment), F.lit("1970-01-01").cast("date")) * 86400.0 + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)


def date_parts(moment: Column) -> Column:
    return F.struct(*[f(moment).alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second))])


#: Ways of writing a moment, tried in this order after a camera's own; those with a zone come first.
LOOSE_MOMENTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy:MM:dd", "yyyy/MM/dd", "d MMMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss", "MMMM d, yyyy", "MMM d, yyyy")


def exif_date(text: Column) -> Column:
    """A camera's date: `2018:01:31 23:59:59`, or with dashes, or else one of LOOSE_MOMENTS (in UTC, where it names a
    zone); null for blank, zero or unreadable ones."""
    clean = cleaned(text)
    usable = clean.isNotNull() & (clean != "") & ~text.rlike(r"^[\s:-]+") & ~F.startswith(clean, F.lit("0000"))
    as_dashes = F.regexp_replace(clean, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    # fractions of a second are dropped
    whole = F.regexp_replace(clean, r"(:\d{2})\.\d+", "$1")
    plain = lambda t, kind: F.try_to_timestamp(t, F.lit(kind)).cast("timestamp_ntz")
    zoned = lambda t, kind: F.convert_timezone(F.current_timezone(), F.lit("UTC"), plain(t, kind))
    tried = [plain(as_dashes, "yyyy-MM-dd HH:mm:ss")] + [zoned(whole, k) if k.endswith("XXX") else plain(whole, k) for k in LOOSE_MOMENTS]
    return F.when(usable, F.coalesce(*tried))


def iso_8601(moment: Column) -> Column:
    """`2018-01-31T23:59:59Z`: a moment without a zone is taken as UTC."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def in_years(moment: Column, first: int | None, last: int | None) -> Column:
    """Whether a moment lies in the years, as a range of the column itself, so that a scan can skip by it."""
    out = F.lit(True)
    if first is not None:
        out &= moment >= F.lit(f"{first:04d}-01-01 00:00:00").cast("timestamp_ntz")
    if last is not None:
        out &= moment < F.lit(f"{last + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    return out


def earliest(*moments: Column) -> Column:
    """The least that isn't null."""
    return F.least(*moments)


def gps_decimal(parts: Column, reference: Column) -> Column:
    """Degrees, minutes and seconds to signed degrees; null if a part is missing, NaN counts as 0."""
    d = [F.nanvl(F.get(parts, F.lit(k)).cast("double"), F.lit(0.0)) for k in range(3)]
    return (d[0] + d[1] / 60 + d[2] / 3600) * F.when(reference.isin("S", "W"), -1).otherwise(1)


def gps_pair(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> tuple[Column, Column]:
    """Latitude and longitude, both -999 unless both are there."""
    y, x = gps_decimal(lat, lat_ref), gps_decimal(lon, lon_ref)
    both = y.isNotNull() & x.isNotNull() & lat_ref.isNotNull() & lon_ref.isNotNull()
    return F.when(both, y).otherwise(NO_GPS), F.when(both, x).otherwise(NO_GPS)


def valid_latitude(value: Column) -> Column:
    return (value == NO_GPS) | ((value > -90) & (value < 90))


def valid_longitude(value: Column) -> Column:
    return (value == NO_GPS) | ((value > -180) & (value < 180))


def turned(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height after the turn that an orientation code of 5 to 8 asks for."""
    aside = orientation.between(5, 8)
    return F.when(aside, height).otherwise(width), F.when(aside, width).otherwise(height)


def content_hash(content: Column, shape: Column) -> Column:
    return F.sha2(F.concat(content, F.encode(shape, "UTF-8")), 256)
