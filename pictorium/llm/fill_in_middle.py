"""Fill-in-middle: a text's middle moves to its end, by rotations of blocks within one byte array.

A text is cut into lines (each with its line feed; the last may lack it). Two cuts, drawn from a hash of the document's
id, part prefix, middle and suffix. The three sentinels are inserted in front of their segments in a bytearray that
holds the text, so the array reads P prefix M middle S suffix. Segments then change places where they lie: reversing
two neighbouring blocks and then the stretch that both fill exchanges them. `psm` exchanges the middle and the suffix;
`spm` brings the suffix to the front of both others. Restoring finds the sentinels, makes the same rotation the other
way round and deletes them, which gives the very bytes of the text.

A text is left as it is (`plain`) if it is empty, holds a sentinel, or the draw says so. Sentinels begin with the one
"<" that they hold and end with the one ">", so text beside a sentinel can't make up another one.

The draw depends on the seed and the id alone: h1 to h4 are the first four groups of eight hex digits of SHA-256 of
"seed:id". A null id counts as empty text there. Null text counts as empty; repeated rows give repeated rows; ties
can't arise; an empty table gives no rows; other columns are ignored. A very long text is a slice of its own: memory
is some four times its bytes. One pass over the table, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pictorium.llm.common import id_and_text, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of texts that are rearranged, and per cent of those that begin with their suffix.
RATE, SPM_RATE, SEED = 100, 50, 7
FIELDS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def line_ends(text: bytes) -> np.ndarray:
    """Where each line of the text ends, its line feed included."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def rotated(held: bytearray, begin: int, cut: int, end: int) -> None:
    """Exchanges [begin, cut) and [cut, end) in place, by three reversals."""
    view = np.frombuffer(held, np.uint8)
    for a, b in ((begin, cut), (cut, end), (begin, end)):
        # swap the halves of the stretch from outside in; an odd one's centre stays
        half = (b - a) // 2
        left = view[a : a + half].copy()
        view[a : a + half] = view[b - half : b][::-1]
        view[b - half : b] = left[::-1]


def characters(part: bytes | memoryview) -> int:
    """Code points of UTF-8: all bytes but continuations."""
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def rearranged(text: bytes, first: int, second: int, spm: bool) -> bytes:
    """The text with its middle, from byte `first` to byte `second`, at its end."""
    held = bytearray(text)
    # from behind, so that the earlier cuts stay where they are
    held[second:second] = SUFFIX
    held[first:first] = MIDDLE
    held[0:0] = PREFIX
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotated(held, 0 if spm else middle, suffix, len(held))
    return bytes(held)


def restored_text(output: bytes, form: str) -> bytes:
    """The text that the output was made of."""
    if form == "plain":
        return output
    held = bytearray(output)
    suffix, prefix, middle = (held.find(s) for s in (SUFFIX, PREFIX, MIDDLE))
    if form == "spm":
        # suffix | prefix, middle
        length = prefix
        rotated(held, 0, length, len(held))
        middle -= length
    else:
        # prefix, suffix | middle
        length = middle - suffix
        rotated(held, suffix, middle, len(held))
        middle = suffix
    suffix = len(held) - length
    del held[suffix : suffix + len(SUFFIX)]
    del held[middle : middle + len(MIDDLE)]
    del held[: len(PREFIX)]
    return bytes(held)


def one(doc_id: int | None, text: bytes, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple:
    """The row of FIELDS for a text."""
    ends = line_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    spm = h4 % 100 < spm_rate
    view = memoryview(text)
    return doc_id, n, "spm" if spm else "psm", characters(view[:first]), characters(view[first:second]), rearranged(text, first, second, spm)


def filled_in_middle(docs: DataFrame, *, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars and middle_chars (null if plain) and the output text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, as_bytes=True):
            rows = [one(i, t, rate, spm_rate, seed) for i, t in zip(part["doc_id"], part["text"], strict=True)]
            columns = list(zip(*rows, strict=True))
            # the bytes are UTF-8, for segments are exchanged at line ends only
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(kind) if name == "output" else pa.array(c, kind) for c, (name, kind) in zip(columns, FIELDS.items(), strict=True)], list(FIELDS))

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def restored(rows: DataFrame) -> DataFrame:
    """The rows of `filled_in_middle` with `restored`, the text rebuilt from output and form alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices([batch.select(["output", "form"])], size="output", as_bytes=True):
                n = len(part["form"])
                texts = [restored_text(o, f) for o, f in zip(part["output"], part["form"], strict=True)]
                kept = batch.slice(done, n)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "restored"])
                done += n

    return rows.mapInArrow(run, SCHEMA + ", restored string")
