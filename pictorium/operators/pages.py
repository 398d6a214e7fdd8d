"""Pages of a large ordered table: a deep page reads the ranges that hold it, not all rows before it.

The table is written once, dealt to ranges of its order, each range in a folder of its own, with the number of its rows
and its first key. A page by number finds its ranges by adding up the numbers; the page after a key finds the range that
holds the key. Either reads one range or the few that it reaches into.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pictorium.sources.shared import shared_folder

RANGE_ROWS = 50_000


class Range(NamedTuple):
    part: int
    n: int
    before: int
    first: tuple


class Paged:
    """Rows in an order (columns that tell them apart, no nulls among them) in ranges of about `range_rows` rows."""

    def __init__(self, rows: DataFrame, order: Sequence[str], range_rows: int = RANGE_ROWS):
        self.spark, self.order = rows.sparkSession, tuple(order)
        self.folder, self.schema = shared_folder(self.spark), rows.schema
        parts = max(1, -(-rows.count() // range_rows))
        cut = rows.repartitionByRange(parts, *self.order).withColumn("_part", F.spark_partition_id())
        cut.write.partitionBy("_part").parquet(self.folder)
        key = F.struct(*self.order)
        sizes = self._every().groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
        found = sorted(sizes.collect(), key=lambda r: r["_part"])  # a row a range
        ends = list(accumulate(r["n"] for r in found))
        self.ranges = [Range(r["_part"], r["n"], end - r["n"], tuple(r["first"])) for r, end in zip(found, ends, strict=True)]
        self.total = ends[-1] if ends else 0

    def _every(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_part", IntegerType())])).parquet(self.folder)

    def _of(self, ranges: list[Range]) -> DataFrame:
        """The rows of some ranges; others' files aren't opened."""
        return self._every().where(F.col("_part").isin([r.part for r in ranges])).drop("_part").orderBy(*self.order)

    def at(self, offset: int, size: int) -> DataFrame:
        """Rows offset + 1 to offset + size."""
        held = [r for r in self.ranges if r.before < offset + size and r.before + r.n > offset]
        skip = offset - held[0].before if held else 0
        return self._of(held).offset(skip).limit(size)

    def page(self, number: int, size: int) -> DataFrame:
        """A page by its number, from 1, with the number of all rows and whether there is one before and one after."""
        rows = self.at((number - 1) * size, size)
        return rows.withColumns({"total": F.lit(self.total).cast("long"), "has_previous": F.lit(number > 1), "has_next": F.lit(number * size < self.total)})

    def after(self, key: tuple, size: int) -> DataFrame:
        """The `size` rows after a key (values of the order's columns)."""
        at = max((k for k, r in enumerate(self.ranges) if r.first <= key), default=0)
        held, n = [], 0
        for r in self.ranges[at:]:
            held.append(r)
            # of the first range any number may lie before the key
            n += r.n if len(held) > 1 else 0
            if n >= size:
                break
        return self._of(held).where(F.struct(*self.order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(self.order, key, strict=True)])).limit(size)
