"""Exact medians of groups of any size.

A group of at most HELD values is sorted by one task and its middle taken. Larger groups, of which there are few, are
found by counting: no such group's values are ever held together. The values of each are counted in ranges between its
least and greatest one; the range that holds the wanted place is looked into again, and so on, until the place is known: a
range's least and greatest values are kept with its count, so a range with one value, or a place at its edge, settles it.
Each pass is one partial aggregation with at most RANGES rows a group; a pass narrows a group's range at least by a factor
of RANGES, so dates take two or three.

A median of an even number of values is the mean of the two in the middle, so two places are looked for. Null values
don't count, nor do NaN and rows without a key. Groups without values have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictorium.sources.shared import written

RANGES = 256
#: Rows of a group that one task may sort.
HELD = 100_000
#: Groups of at most so many rows are broadcast (40 bytes each). More are joined by sorting; a group of more than HELD rows
#: is dealt to SALTS tasks then.
BROADCAST_GROUPS, SALTS = 200_000, 16


def attached(rows: DataFrame, groups: DataFrame, key: str, n_groups: int) -> DataFrame:
    """The rows of those groups (key, n and more) with their columns but n; a group with most of the rows is many tasks."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups.drop("n")), key)
    large = groups.where(F.col("n") > HELD).select(key, F.lit(SALTS).alias("_salts"))
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HELD, F.lit(SALTS - 1)).otherwise(F.lit(0))))).drop("n")
    # the groups' files are small for their rows: by their size alone Spark would broadcast any number of them
    return dealt.join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def _range(value: Column) -> Column:
    """The range that a value lies in, of RANGES between `low` and `high`: never falling, the ends in different ones."""
    # halves first: the difference of two doubles may be beyond all doubles
    share = (value / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    return F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The key, `median` and n of each group that has values."""
    values = rows.select(key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & F.col(key).isNotNull())
    sizes = values.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    large = written(sizes.where(F.col("n") > HELD))
    if large.isEmpty():
        return _sorted_medians(values, key)
    return _sorted_medians(values.join(F.broadcast(large.select(key)), key, "left_anti"), key).unionByName(_counted_medians(values, large, key))


def _sorted_medians(values: DataFrame, key: str) -> DataFrame:
    """Of groups that one task may sort."""
    of_group = Window.partitionBy(key)
    placed = values.withColumns({"place": F.row_number().over(of_group.orderBy("_v")), "n": F.count(F.lit(1)).over(of_group)})
    middle = placed.where((F.col("place") == F.floor((F.col("n") + 1) / 2)) | (F.col("place") == F.floor(F.col("n") / 2) + 1))
    return middle.groupBy(key).agg(F.avg("_v").alias("median"), F.any_value("n").alias("n"))


def _counted_medians(values: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Of the few groups with more values; found: key, n, low and high."""
    places = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    # one row for each place that is looked for: `left` values of the range come before it
    open_ = written(found.withColumn("place", F.explode(F.array_distinct(places))).withColumn("left", F.col("place")))
    settled = []
    while True:
        done = F.when((F.col("left") == 0) | (F.col("low") == F.col("high")), F.col("low"))
        done = F.coalesce(done, F.when(F.col("left") == F.col("held") - 1, F.col("high"))) if "held" in open_.columns else done
        judged = open_.withColumn("found", done)
        settled.append(judged.where("found is not null").select(key, "n", "found"))
        more = judged.where("found is null").select(key, "n", "place", "left", "low", "high")
        if more.isEmpty():
            break
        inside = values.join(F.broadcast(more), key).where(F.col("_v").between(F.col("low"), F.col("high")))
        counts = inside.groupBy(key, "place", "n", "left", _range(F.col("_v")).alias("range")).agg(F.count(F.lit(1)).alias("held"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        before = F.sum("held").over(Window.partitionBy(key, "place").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
        here = counts.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("held")))
        open_ = written(here.select(key, "n", "place", (F.col("left") - F.col("before")).alias("left"), F.col("least").alias("low"), F.col("most").alias("high"), "held"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.groupBy(key).agg(F.avg("found").alias("median"), F.any_value("n").alias("n"))
