"""Camera tags read from the bytes of a picture: a walk over JPEG segments and TIFF directories, without any library.

A JPEG file is a chain of segments, each with its length; the camera's is the one that names itself. It holds a small
TIFF file: a byte order, and directories of entries (tag, type, number, value or where the value lies). The top
directory points to the camera's own and to the place's. All offsets count from the byte order's mark and are checked
against what is there; a directory that was read before isn't read again. What can't be read gives no tags and a reason: no part of a damaged file
is trusted.

Only the head of a file goes to the workers' Python: HEAD bytes, for the camera's segment comes before the pixels and is
64 KB at most. The results are text, as `pictures.tag_columns` takes them: numbers of a list parted by blanks, fractions
as decimal numbers.
"""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pictorium.sources.pictures import CAMERA_DIRECTORY, GPS_TAGS, PLACE_DIRECTORY, TAGS

HEAD = 256 * 1024
#: More entries than any camera writes into one directory, and more numbers into one entry: such a count is a lie.
MOST_ENTRIES, MOST_BYTES = 512, 65_536
#: By type, the bytes of one value and how it is unpacked (fractions: two numbers).
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
RESULT = "struct<tags: map<string,string>, problem: string>"
BYTE_ORDERS = {"<": "little", ">": "big"}
#: An entry: tag, type, number, and the value's offset (or the value, where it is short).
ENTRIES = {order: struct.Struct(order + "HHII") for order in BYTE_ORDERS}
#: What is read of the top directory and the camera's, and of the place's.
TOP, PLACE = frozenset((*TAGS, CAMERA_DIRECTORY, PLACE_DIRECTORY)), frozenset(GPS_TAGS)


class Unreadable(ValueError):
    """Why a file gives no tags."""


def camera_segment(head: bytes, whole: bool = True) -> bytes | None:
    """The TIFF part of the camera's segment; None if a sound file has none. `whole`: nothing follows the head."""
    if head[:2] != b"\xff\xd8":
        raise Unreadable("no picture")
    at = 2
    while True:
        # fill bytes may stand before a marker
        while head[at : at + 2] == b"\xff\xff":
            at += 1
        if len(head) < at + 2:
            raise Unreadable("cut short" if whole else "beyond the head")
        if head[at] != 0xFF:
            raise Unreadable("no marker")
        kind = head[at + 1]
        if kind in (0xD9, 0xDA):
            return None  # the end, or the pixels begin
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2  # markers without a length
            continue
        if len(head) < at + 4:
            raise Unreadable("cut short" if whole else "beyond the head")
        length = int.from_bytes(head[at + 2 : at + 4], "big")
        if length < 2:
            raise Unreadable("length too small")
        if kind == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            if len(head) < at + 2 + length:
                raise Unreadable("cut short" if whole else "beyond the head")
            return head[at + 10 : at + 2 + length]
        at += 2 + length


def directory(part: bytes, at: int, order: str, seen: set[int], wanted: frozenset[int]) -> dict[int, object]:
    """Wanted entries of one directory: text, numbers, or lists of numbers; the others are checked all the same, but for
    those of unknown types, which are passed over."""
    if at in seen:
        raise Unreadable("directory read before")
    seen.add(at)
    if not 8 <= at <= len(part) - 2:
        raise Unreadable("offset outside")
    n = int.from_bytes(part[at : at + 2], BYTE_ORDERS[order])
    if n > MOST_ENTRIES or at + 2 + 12 * n > len(part):
        raise Unreadable("entries outside")
    out: dict[int, object] = {}
    where = at - 2
    for tag, kind, count, value in ENTRIES[order].iter_unpack(part[at + 2 : at + 2 + 12 * n]):
        where += 12
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        held = count * size
        if held > MOST_BYTES:
            raise Unreadable("value too long")
        if held > 4 and (value < 8 or value + held > len(part)):
            raise Unreadable("offset outside")
        if tag not in wanted:
            continue
        begin = value if held > 4 else where
        if code == "s":
            found = part[begin : begin + count]
            out[tag] = found.partition(b"\0")[0].decode("latin-1") if kind == 2 else found
            continue
        numbers = unpacking(order, code[0], count * len(code)).unpack_from(part, begin)
        if len(code) == 2:
            numbers = tuple([a / b if b else math.nan for a, b in zip(numbers[::2], numbers[1::2], strict=True)])
        if count:
            out[tag] = numbers[0] if count == 1 else numbers
    return out


@functools.lru_cache(1024)
def unpacking(order: str, code: str, n: int) -> struct.Struct:
    return struct.Struct(f"{order}{n}{code}")


def walked(part: bytes) -> dict[str, str]:
    """Known tags of the top directory, the camera's and the place's, as text."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(part[:4])
    if order is None or len(part) < 8:
        raise Unreadable("no byte order")
    seen: set[int] = set()
    pointer = lambda of, tag: of[tag] if isinstance(of.get(tag), int) else None
    tags = directory(part, int.from_bytes(part[4:8], BYTE_ORDERS[order]), order, seen, TOP)
    camera, place = pointer(tags, CAMERA_DIRECTORY), pointer(tags, PLACE_DIRECTORY)
    if camera is not None:
        tags |= directory(part, camera, order, seen, TOP)
    out = {name: shown(tags[number]) for number, name in TAGS.items() if number in tags}
    if place is not None:
        found = directory(part, place, order, seen, PLACE)
        out |= {name: shown(found[number]) for number, name in GPS_TAGS.items() if number in found}
    return out


def shown(value: object) -> str:
    if isinstance(value, tuple):
        return " ".join([str(float(v)) for v in value])
    return value.decode("latin-1") if isinstance(value, bytes) else str(value)


def tags_of(head: bytes, whole: bool = True) -> tuple[dict[str, str] | None, str | None]:
    """Tags (none of a sound file without the camera's segment) and None, or None and what is wrong."""
    try:
        part = camera_segment(head, whole)
        return ({} if part is None else walked(part)), None
    except Unreadable as why:
        return None, str(why)


def _read(contents: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for heads, whole in contents:
        begins, names, texts, problems = [0], [], [], []
        none: list[bool] = []
        for head, all_of_it in zip(heads, whole, strict=True):
            tags, problem = tags_of(head.as_py(), all_of_it.as_py()) if head.is_valid else (None, None)
            if tags:
                names += tags
                texts += tags.values()
            begins.append(len(names))
            none.append(tags is None)
            problems.append(problem)
        offsets = pa.array(begins, pa.int32(), mask=np.array([*none, False]))  # a null offset is a null map
        maps = pa.MapArray.from_arrays(offsets, pa.array(names, pa.string()), pa.array(texts, pa.string()))
        yield pa.StructArray.from_arrays([maps, pa.array(problems, pa.string())], ["tags", "problem"])


def camera_tags(content: Column, head: int = HEAD) -> Column:
    """content -> tags and problem, both null for a null content."""
    read = F.arrow_udf(_read, RESULT)
    return read(F.substring(content, F.lit(1), F.lit(head)), F.octet_length(content) <= head)
