"""Connected components of a graph held in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.llm.common import dropped, mark, written


def _stars(edges: DataFrame, *, large: bool) -> DataFrame:
    """Hangs each node's neighbours on the least of them and itself: the larger ones (large), or the smaller ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node and root, the least node of its component, for every node of an edge.

    Loops and repeated edges do no harm, edges with a null end are dropped, no edges give no rows. Each round is
    written to the shared folder, in place of the one before; the number of rounds grows with the logarithm of the graph, and only counts and a
    checksum reach the driver.
    """
    now = written(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    last, before = None, mark() - 1
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            break
        last = seen
        now = written(_stars(_stars(now, large=True), large=False))
        dropped(edges.sparkSession, before, keep=1)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
