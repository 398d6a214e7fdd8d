"""Shared parts of the corpus operators: shared-folder tables, slices of Arrow batches, worker caches."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.sources.shared import dropped as dropped
from pictorium.sources.shared import mark as mark
from pictorium.sources.shared import shared_folder as shared_folder
from pictorium.sources.shared import written as written

#: Text of one slice. Word lists of a slice take some twenty times this much memory.
SLICE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its own name, whatever it holds: dots, blanks or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns (or all but some) as one struct, under their own names."""
    return F.struct(*([column(c).alias(c) for c in df.columns if c not in without] or [F.lit(0).alias("none")]))


def opened(row: Column, names: list[str]) -> list[Column]:
    """The fields of a struct as columns again."""
    return [row.getField(c).alias(c) for c in names]


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, null as empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], *, size: str = "text", as_bytes: bool = False) -> Iterator[dict[str, list]]:
    """Columns as Python lists, some SLICE_BYTES of the column `size` at a time; a longer text is a slice of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(size)
        text = batch.column(at)
        lengths = pc.binary_length(text).to_pylist()
        begin = held = 0
        for i, n in enumerate([*lengths, None]):
            if n is None or held and held + n > SLICE_BYTES:
                if i > begin:
                    part = batch.slice(begin, i - begin)
                    out = {name: part.column(k) for k, name in enumerate(batch.schema.names)}
                    if as_bytes:
                        out[size] = out[size].cast(pa.binary())
                    yield {name: column.to_pylist() for name, column in out.items()}
                begin, held = i, 0
            held += n or 0


@functools.cache
def _trimmed() -> Callable[[], object]:
    """Hands free memory of the C library back to the system, where it can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    return (lambda: trim(0)) if trim else (lambda: None)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for `mapInArrow`; after its last batch the worker, which lives on for other stages, gives back
    what Arrow and the C library keep for it."""

    @functools.wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trimmed()()

    return wrapped


class BoundedCache(dict):
    """A worker's dictionary of about `limit` bytes: when it is full, it starts afresh.

    Entries are only ever a shortcut, so emptying it changes no result. What one text asks for stays until the next
    one, so the bound is `limit` and one text's own keys. `weight`: bytes of key and value for each byte of a key.
    """

    ENTRY = 120

    def __init__(self, limit: int, weight: float = 1.0):
        super().__init__()
        self.limit, self.weight, self.held = limit, weight, 0

    def absent(self, keys: set) -> list:
        """The keys that have to be worked out, after making room for them."""
        missing = [k for k in keys if k not in self]
        if not missing:
            return missing
        room = self._room(missing)
        if self.held and self.held + room > self.limit:
            self.clear()
            missing = list(keys)
            room, self.held = self._room(missing), 0
        self.held += room
        return missing

    def _room(self, keys: list) -> float:
        return self.ENTRY * len(keys) + self.weight * sum(map(sys.getsizeof, keys))


def word_count(text: Column) -> Column:
    """Number of words, where a word is a run of characters other than the six ASCII spaces."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
