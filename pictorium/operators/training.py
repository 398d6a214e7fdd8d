"""Training sets from the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictorium.sources.shared import numbered


def labels(rows: DataFrame, key: str) -> DataFrame:
    """Distinct values of a key with labels 0..K-1 in their order."""
    distinct = rows.select(key).where(F.col(key).isNotNull()).distinct()
    return numbered(distinct, [key]).select(key, (F.col("number") - 1).alias("label"))


def thirds(rows: DataFrame, by: str, order: tuple[str, ...], parts: int = 3) -> DataFrame:
    """Each group's rows in order, cut into equal parts (0, 1, ...); what is left over goes."""
    group = Window.partitionBy(by)
    numbered = rows.withColumn("n", F.count(F.lit(1)).over(group)).withColumn("place", F.row_number().over(group.orderBy(*order)) - 1)
    size = F.floor(F.col("n") / parts)
    return numbered.where((size > 0) & (F.col("place") < size * parts)).withColumn("part", F.floor(F.col("place") / size).cast("int")).drop("n", "place")


def rare_merged(rows: DataFrame, label: str, least: int, other: int) -> DataFrame:
    """Labels with fewer than `least` rows become `other`."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(counts, label).withColumn("merged", F.when(F.col("n") >= least, F.col(label)).otherwise(F.lit(other))).drop("n")


def joined_features(first: Column, second: Column) -> Column:
    return F.concat(first.cast("array<double>"), second.cast("array<double>"))


def balanced_accuracy(rows: DataFrame, truth: str, guess: str, tolerance: float = 0.5) -> DataFrame:
    """The mean over classes of the share guessed within the tolerance."""
    per = rows.groupBy(truth).agg(F.avg(F.when(F.abs(F.col(guess) - F.col(truth)) < tolerance, 1.0).otherwise(0.0)).alias("share"))
    return per.agg(F.avg("share").alias("balanced_accuracy"), F.count(F.lit(1)).alias("n_classes"))


def pairs(rows: DataFrame, seed: int, per_row: int = 1, negatives_from: Column | None = None, share: float = 0.3) -> DataFrame:
    """Pairs for a comparing network: for each row one of its own label and one of another, fixed by the seed.

    rows: id, label. Within a label, and over all rows, each row is paired with the next in a hashed order, so neither
    a label nor the whole is ever held against itself. `negatives_from` marks rows (ignored faces, say) that make up
    about `share` of the negatives.
    """
    mixed = rows.withColumn("h", F.xxhash64("id", F.lit(seed)))
    same = Window.partitionBy("label").orderBy("h", "id")
    positive = mixed.select("id", F.lead("id").over(same).alias("other"), F.lit(1).alias("same")).where("other is not null")
    # the whole in buckets of some thousand rows: a window without a key would be one task
    bucket = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1024))
    drawn = mixed.withColumn("bucket", bucket)
    if negatives_from is not None:
        ignored = drawn.where(negatives_from)
        usual = drawn.where(~negatives_from)
        limit = F.pmod(F.col("h"), F.lit(1000)) < int(1000 * share)
        wide = Window.partitionBy("bucket").orderBy("h", "id")
        firsts = usual.where(limit).withColumn("place", F.row_number().over(wide))
        seconds = ignored.withColumn("place", F.row_number().over(wide)).select("bucket", "place", F.col("id").alias("other"))
        from_ignored = firsts.join(seconds, ["bucket", "place"]).select("id", "other", F.lit(0).alias("same"))
        drawn = usual.where(~limit)
    order = Window.partitionBy("bucket").orderBy("h", "id")
    shifted = drawn.withColumn("other", F.lead("id").over(order)).withColumn("other_label", F.lead("label").over(order))
    negative = shifted.where("other is not null and other_label <> label").select("id", "other", F.lit(0).alias("same"))
    out = positive.unionByName(negative)
    return out if negatives_from is None else out.unionByName(from_ignored)
