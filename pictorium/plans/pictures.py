"""Camera tags from the bytes of pictures that are made of the driver tables."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.functions import values as V
from pictorium.plans import stand_ins as S
from pictorium.plans.registry import query
from pictorium.sources import exif
from pictorium.sources.pictures import tag_columns

_ASCII, _SHORT, _LONG, _RATIONAL = 2, 3, 4, 5


#: Bytes of one value by type.
_SIZE = {_ASCII: 1, _SHORT: 2, _LONG: 4, _RATIONAL: 8}


class _Piece(NamedTuple):
    """Bytes in the row's byte order: a number of so many of them, or (size 0) hexadecimal digits as they are."""

    value: Column | int
    size: int


def _number(value: Column | int, size: int) -> list[_Piece]:
    return [_Piece(value, size)]


def _text(value: Column, size: int) -> list[_Piece]:
    """The text, ended by a zero byte and filled with more of them."""
    return [_Piece(F.rpad(F.hex(F.encode(value, "UTF-8")), 2 * size, "0"), 0)]


def _fraction(above: Column | int, below: Column | int) -> list[_Piece]:
    return _number(above, 4) + _number(below, 4)


def _directory(at: int, entries: list[tuple[int, int, int, list[_Piece]]]) -> list[_Piece]:
    """Entries (tag, type, count, value) at an offset; values of more than four bytes lie behind them."""
    behind, rows, values = at + 2 + 12 * len(entries) + 4, [], []
    for tag, kind, count, value in entries:
        n = count * _SIZE[kind]
        rows += _number(tag, 2) + _number(kind, 2) + _number(count, 4)
        if n <= 4:
            rows += value + (_number(0, 4 - n) if n < 4 else [])
        else:
            rows += _number(behind, 4)
            values += value
            behind += n
    return _number(len(entries), 2) + rows + _number(0, 4) + values


def _turned(value: Column, size: int) -> Column:
    """The number with its bytes in the other order."""
    byte = lambda k: F.shiftleft(F.shiftright(value, 8 * k).bitwiseAND(F.lit(255)), 8 * (size - 1 - k))
    return reduce(Column.bitwiseOR, [byte(k) for k in range(size)])


def _hexadecimal(pieces: list[_Piece], big: Column) -> Column:
    """All pieces behind each other; fixed ones that follow each other are one text for each byte order. One expression
    digests all of them, so that a header of many pieces stays compilable."""
    out: list[Column] = []
    part = lambda number, size, digits: F.struct(number.alias("v"), F.lit(2 * size).alias("n"), digits.alias("h"))
    zero, blank = F.lit(0).cast("long"), F.lit("")
    for fixed, group in groupby(pieces, lambda p: isinstance(p.value, int)):
        run = list(group)
        if fixed:
            two = ["".join(p.value.to_bytes(p.size, order).hex() for p in run).upper() for order in ("big", "little")]
            out.append(part(zero, 0, F.when(big, two[0]).otherwise(two[1])))
            continue
        for value, size in run:
            number = value.cast("long") if size else zero
            out.append(part(F.when(big, number).otherwise(_turned(number, size)), size, blank) if size else part(zero, 0, value))
    return F.array_join(F.transform(F.array(*out), lambda p: F.when(p["n"] == 0, p["h"]).otherwise(F.lpad(F.hex(p["v"]), p["n"], F.lit("0")))), "")


def _length(entries: list[tuple[int, int, int]]) -> int:
    return 2 + 12 * len(entries) + 4 + sum(n for _, kind, count in entries if (n := count * _SIZE[kind]) > 4)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and content: a JPEG head for each order. Every 11th is cut short, every 13th names its own directory as the
    camera's, every 17th has an offset beyond the end, every 19th has no camera segment; the others are sound."""
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    big = key % 2 == 0
    stamp = _text(F.date_format(at, "yyyy:MM:dd HH:mm:ss"), 20)
    shapes = [[(271, _ASCII, 8), (274, _SHORT, 1), (306, _ASCII, 20), (0x8769, _LONG, 1), (0x8825, _LONG, 1)], [(33434, _RATIONAL, 1), (33437, _RATIONAL, 1), (34855, _SHORT, 1), (36867, _ASCII, 20), (37385, _SHORT, 1), (37386, _RATIONAL, 1)], [(1, _ASCII, 2), (2, _RATIONAL, 3), (3, _ASCII, 2), (4, _RATIONAL, 3)]]
    begins = [8, 8 + _length(shapes[0]), 8 + _length(shapes[0]) + _length(shapes[1])]
    camera = F.when(key % 13 == 0, 8).when(key % 17 == 0, 60_000).otherwise(begins[1])
    degrees = lambda n, m: _fraction(n, 1) + _fraction(m, 1) + _fraction(30, 2)
    values = [
        [_text(F.concat(F.lit("Cam "), (key % 90 + 10).cast("string")), 8), _number(1 + key % 8, 2), stamp, _number(camera, 4), _number(begins[2], 4)],
        [_fraction(1, 2 + key % 500), _fraction(14 + key % 50, 10), _number(100 + key % 3000, 2), stamp, _number(key % 2, 2), _fraction(180 + key % 700, 10)],
        [_text(F.when(key % 3 == 0, "S").otherwise("N"), 2), degrees(key % 89, key % 60), _text(F.when(key % 5 == 0, "W").otherwise("E"), 2), degrees(key % 179, key % 59)],
    ]
    directories = [d for b, shape, row in zip(begins, shapes, values, strict=True) for d in _directory(b, [(*e, v) for e, v in zip(shape, row, strict=True)])]
    tiff = F.concat(F.when(big, "4D4D").otherwise("4949"), _hexadecimal(_number(42, 2) + _number(8, 4) + directories, big))
    part = F.concat(F.hex(F.lit(b"Exif\0\0")), tiff)
    segment = lambda marker, body, size: F.concat(F.lit(f"FF{marker}"), F.lpad(F.hex((size + 2).cast("long")), 4, "0"), body)
    order = F.concat(F.lit("order "), key.cast("string"))
    comment = segment("FE", F.hex(F.encode(order, "UTF-8")), F.length(order))
    size = 6 + begins[2] + _length(shapes[2])
    whole = F.concat(F.lit("FFD8"), comment, F.when(key % 19 == 0, F.lit("")).otherwise(segment("E1", part, F.lit(size))), F.lit("FFDA0008"))
    cut = F.substring(whole, F.lit(1), F.when(key % 11 == 0, 200).otherwise(4 * size))
    # a small file is few tasks, and a picture is far more work than its row: keys and dates are dealt to all cores
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key, at).repartition(key)
    return orders.select(key.alias("id"), F.unhex(cut).alias("content"))


@query("""SELECT id, CASE WHEN ok THEN 'Cam ' || CAST(id % 90 + 10 AS VARCHAR) END AS camera_make, CAST(CASE WHEN ok THEN 1 + id % 8 ELSE 1 END AS INT) AS orientation, CAST(CASE WHEN ok THEN 1 END AS INT) AS exposure_num, CAST(CASE WHEN ok THEN 2 + id % 500 END AS INT) AS exposure_denom,
  CASE WHEN ok THEN round((14 + id % 50) / 10, 6) END AS fnumber, CAST(CASE WHEN ok THEN 100 + id % 3000 END AS INT) AS iso_value, CAST(CASE WHEN ok THEN id % 2 END AS INT) AS flash_info, CASE WHEN ok THEN round((180 + id % 700) / 10, 6) END AS focal,
  CASE WHEN ok THEN round((id % 89 + (id % 60) / 60 + 15 / 3600) * CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END, 6) ELSE -999 END AS gps_lat_decimal, CASE WHEN ok THEN round((id % 179 + (id % 59) / 60 + 15 / 3600) * CASE WHEN id % 5 = 0 THEN -1 ELSE 1 END, 6) ELSE -999 END AS gps_lon_decimal,
  CASE WHEN ok THEN epoch(taken) END AS taken_sec, CASE WHEN id % 11 = 0 AND (id % 19 <> 0) THEN 'cut short' WHEN id % 19 = 0 THEN NULL WHEN id % 13 = 0 THEN 'directory read before' WHEN id % 17 = 0 THEN 'offset outside' END AS problem
  FROM (SELECT o_orderkey AS id, o_orderdate AS taken, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS ok FROM orders)""")  # fmt: skip
def exif_from_bytes(spark, sf_dir):
    read = headers(spark, sf_dir).select("id", exif.camera_tags(F.col("content")).alias("read")).select("id", "read.*")
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    rows = read.withColumns(tag_columns(tags))
    share = lambda name: S.rounded(F.col(f"{name}_num") / F.col(f"{name}_denom")).alias(name)
    return rows.select("id", "camera_make", "orientation", "exposure_num", "exposure_denom", share("fnumber"), "iso_value", "flash_info", share("focal"), S.rounded(F.col("gps_lat_decimal")).alias("gps_lat_decimal"), S.rounded(F.col("gps_lon_decimal")).alias("gps_lon_decimal"), V.epoch_seconds(F.col("date_taken")).alias("taken_sec"), "problem")
