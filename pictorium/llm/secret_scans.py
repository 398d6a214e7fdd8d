"""Secrets in texts: an Aho-Corasick automaton finds keywords, and only there expressions are tried.

The automaton reads each text twice, as UTF-8 bytes: once with A-Z lowered, for the literal keywords, and once folded to
two symbols (hexadecimal digit or not), where a keyword of 24 digit symbols stands for every long hexadecimal run. At a
hit, and nowhere else, the kind's expression is matched, anchored there. As every match of an expression begins with one
of its keywords, going through the hits from left to right and skipping those inside the last match finds what a search
over the whole text would: the leftmost matches that don't overlap. A match that fails its kind's condition is dropped;
its stretch isn't tried again.

| Kind | Expression | Condition |
| assign | keyword, `:` or `=`, value, blanks and quotes between | a value of 6 characters at least |
| access | AKIA and capitals or digits | 20 characters at least |
| hex | hexadecimal digits | 24 characters at least |
| github | ghp_, gho_, ghu_, ghs_ or ghr_ and letters or digits | 36 of them, the last six being the checksum of the others |
| npm | npm_ and letters or digits | as github |

The checksum of the last two kinds is CRC-32 in base 62, six digits with leading zeros: a token that somebody made up or
mistyped fails it, so these spans are certain.

A null id and repeated rows are scanned row by row; null text counts as empty and has no spans; ties (spans that start
together) are in the order of the kinds above; an empty table gives no rows; other columns are ignored by `secrets` and
kept by `redacted`. Texts of any length are read whole, WINDOW bytes at a time through the automaton. Positions are in
code points, ends are exclusive. One pass over the table, nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from pictorium.llm.common import id_and_text, opened, slices, whole_row

LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, TOKEN = 6, 20, 24, 36
#: Fixed value: the digits of base 62, in order.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Bytes of a text that the automaton reads at once.
WINDOW = 1_000_000
_DIGIT, _OTHER = 1, 2
_FOLD = bytes(_DIGIT if chr(b) in "0123456789abcdef" else _OTHER for b in range(256))


def checksum_holds(body: bytes) -> bool:
    """Whether the last six of 36 letters and digits are the CRC-32 of the others in base 62."""
    left, digits = zlib.crc32(body[:-6]), ""
    for _ in range(6):
        left, digit = divmod(left, 62)
        digits = BASE62[digit] + digits
    return body[-6:] == digits.encode()


def _token(m: re.Match[bytes]) -> bool:
    return len(m.group(1)) == TOKEN and checksum_holds(m.group(1))


class Kind(NamedTuple):
    """`keywords`: what every match begins with, in lower case; `holds`: which matches count."""

    name: str
    keywords: tuple[bytes, ...]
    expression: re.Pattern[bytes]
    holds: object


KINDS = (
    Kind("assign", (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(1)) >= LEAST_VALUE),
    Kind("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= LEAST_ACCESS),
    Kind("hex", (bytes([_DIGIT]) * LEAST_HEX,), re.compile(rb"[0-9a-f]+"), lambda m: True),
    Kind("github", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]+)"), _token),
    Kind("npm", (b"npm_",), re.compile(rb"npm_([A-Za-z0-9]+)"), _token),
)
NAMES = tuple(k.name for k in KINDS)
BASE = NAMES[:3]
SPAN = "struct<kind: string, start: long, end: long>"


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    """All keywords, each with its kind and length; one automaton a worker."""
    out = ahocorasick.Automaton()
    for k, kind in enumerate(KINDS):
        for word in kind.keywords:
            out.add_word(word.decode("latin-1"), (k, len(word)))
    out.make_automaton()
    return out


def hits(text: bytes) -> Iterator[tuple[int, int]]:
    """(kind's number, start) of the keywords, for each kind by rising start; of a long hexadecimal run its start and a few inside.

    Windows overlap by less than the longest keyword, so that none is cut; one that lies in the overlap comes twice.
    """
    automaton, overlap = _automaton(), max(len(w) for k in KINDS for w in k.keywords) - 1
    for read, search in ((text.lower(), automaton.iter), (text.translate(_FOLD), automaton.iter_long)):
        for begin in range(0, max(len(read) - overlap, 1), WINDOW - overlap):
            for last, (kind, length) in search(read[begin : begin + WINDOW].decode("latin-1")):
                yield kind, begin + last + 1 - length


def byte_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all secrets in bytes, sorted."""
    out, ends = [], [0] * len(KINDS)
    for kind, start in hits(text):
        if start >= ends[kind] and (m := KINDS[kind].expression.match(text, start)):
            ends[kind] = m.end()
            if KINDS[kind].holds(m):
                out.append((start, kind, m.end()))
    return sorted(out)


def spans(text: bytes) -> list[tuple[int, int, int]]:
    """As `byte_spans`, in code points."""
    found = byte_spans(text)
    if not found or text.isascii():
        return found
    points, at, passed = {}, 0, 0
    for p in sorted({p for a, _, b in found for p in (a, b)}):
        passed += len(text[at:p].decode())
        points[p], at = passed, p
    return [(points[a], k, points[b]) for a, k, b in found]


def masked(text: bytes) -> bytes:
    """The text with each secret replaced by its kind; what overlaps an earlier one is replaced with it."""
    parts, end = [], 0
    for start, kind, stop in byte_spans(text):
        if start >= end:
            parts += [text[end:start], f"<{NAMES[kind].upper()}>".encode()]
        end = max(end, stop)
    return b"".join([*parts, text[end:]]) if end else text


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for part in slices(batches, as_bytes=True):
        found = [[{"kind": NAMES[k], "start": a, "end": b} for a, k, b in spans(text)] for text in part["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(found, kind)], ["doc_id", "spans"])


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end), of every text."""
    return id_and_text(docs).mapInArrow(_scan, f"doc_id long, spans array<{SPAN}>")


def shown(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, each secret in their texts replaced by its kind; a null text stays null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices([batch.select(["text"])], as_bytes=True):
                n = len(part["text"])
                texts = [None if t is None else masked(t) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), batch.column(batch.schema.get_field_index("rest")).slice(done, n)], ["text", "rest"])
                done += n

    rest = [c for c in docs.columns if c != "text"]
    given = docs.select("text", whole_row(docs, ("text",)).alias("rest"))
    out = given.mapInArrow(run, StructType().add("text", StringType()).add(given.schema["rest"]))
    back = dict(zip(rest, opened(F.col("rest"), rest), strict=True))
    return out.select(*[F.col(c) if c == "text" else back[c] for c in docs.columns])
