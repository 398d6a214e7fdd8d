"""Which images hold all people of a set, for a whole table of sets at once; and which texts hold a needle, likewise.

Sets of the same people are one; a set's two least frequent people lead to the few candidates, and only these are verified. A needle is found by one of its
short runs of characters, the one that leads to it at least cost: texts that hold the run, shared among the needles that
have it at the same place and are as long. Each text then gives the stretches that such runs say could be a needle, and
stretches and needles that are equal meet, so a text meets no needle that it doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictorium.sources.shared import written

#: Characters of the runs that needles are found by; shorter needles are runs themselves.
GRAM = 3
#: Tables of runs and needles are broadcast up to so many bytes, counted as they take in memory: their files are far smaller.
BROADCAST_BYTES = 16_000_000


def beside(rows: DataFrame, *texts: str, more: Column | None = None) -> DataFrame:
    """A table to join with (read twice): broadcast if its rows, with what these texts and `more` take, are few enough, else joined by sorting."""
    size = F.lit(64) if more is None else F.lit(64) + more
    for text in texts:
        size = size + F.octet_length(text)
    taken = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(rows) if taken <= BROADCAST_BYTES else rows.hint("merge")


def kinds_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """set_id and people (sorted) of each set; people and kind of those that differ: the least id of the sets with them."""
    given = written(sets.where("set_id is not null and person_id is not null").groupBy("set_id").agg(F.sort_array(F.collect_set("person_id")).alias("people")))
    return given, written(given.groupBy("people").agg(F.min("set_id").alias("kind")))


def holding_all(sets: DataFrame, held: DataFrame) -> DataFrame:
    """set_id, image_id: the images that hold every person of a set.

    sets: set_id, person_id; held: image_id, person_id. Repeated rows and nulls don't count; a set with a person that
    no image holds has no images.
    """
    # sets of the same people are looked for once
    given, kinds = kinds_of(sets)
    sets = kinds.select(F.col("kind").alias("set_id"), F.explode("people").alias("person_id"))
    held = held.where("image_id is not null and person_id is not null").join(sets.select("person_id").distinct(), "person_id", "left_semi")
    held = written(held.distinct())
    frequent = held.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_images"))
    sized = sets.join(frequent, "person_id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))
    of_set = Window.partitionBy("set_id")
    ranked = written(sized.withColumn("size", F.count(F.lit(1)).over(of_set)).withColumn("place", F.row_number().over(of_set.orderBy("n_images", "person_id"))))
    # two rare people lead to far fewer images than one
    pairs = ranked.where("size > 1 and place <= 2").groupBy("set_id", "size").agg(F.min("person_id").alias("p"), F.max("person_id").alias("q"))
    both = pairs.select("p", "q").distinct().join(held.select(F.col("person_id").alias("p"), "image_id"), "p").join(held.select(F.col("person_id").alias("q"), "image_id"), ["q", "image_id"])
    found = pairs.join(both, ["p", "q"]).select("set_id", "size", "image_id")
    others = ranked.where("place > 2").select("set_id", "person_id")
    verified = found.where("size > 2").join(others, "set_id").join(held, ["image_id", "person_id"], "left_semi").groupBy("set_id", "size", "image_id").agg(F.count(F.lit(1)).alias("n")).where("n = size - 2")
    one = ranked.where("size = 1").join(held, "person_id").select("set_id", "image_id")
    every = one.unionByName(found.where("size = 2").select("set_id", "image_id")).unionByName(verified.select("set_id", "image_id"))
    return every.withColumnRenamed("set_id", "kind").join(kinds, "kind").join(given, "people").select("set_id", "image_id")


def _runs(rows: DataFrame, text: str, sizes: Column, gram: str, begin: str) -> DataFrame:
    """Each row with every run of these sizes (an array) in its text, and where it begins (from 1)."""
    last = F.char_length(text) - F.col("_size") + 1
    at = rows.withColumn("_size", F.explode(sizes)).withColumn(begin, F.explode(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))))
    return at.withColumn(gram, F.substring(text, F.col(begin), F.col("_size"))).drop("_size")


class Substrings:
    """Texts (id, text) that are searched for whole tables of needles."""

    def __init__(self, texts: DataFrame, *, any_case: bool = True):
        self.any_case = any_case
        self.texts = texts.select("id", self._folded(F.col("text")).alias("text")).where("text is not null")

    def _folded(self, text: Column) -> Column:
        return F.lower(text) if self.any_case else text

    def ways(self, needles: DataFrame) -> DataFrame:
        """gram, and `at` and `size` of the needles that are found by it; needles: needle, not empty."""
        size = F.char_length("needle")
        placed = _runs(needles.select("needle", size.alias("size")), "needle", F.array(F.least(size, F.lit(GRAM))), "gram", "at")
        asked = written(placed.groupBy("gram", "at", "size").agg(F.count(F.lit(1)).alias("n")))
        counts = self._grams(asked.select("gram").distinct()).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
        cost = written(asked.join(counts.hint("merge"), "gram").select("gram", "at", "size", "n", (F.col("texts") / F.col("n")).alias("cost")))
        # a needle with a run that no text holds is in none
        best = Window.partitionBy("needle").orderBy("cost", F.desc("n"), "at")
        runs = placed.groupBy("needle").agg(F.count(F.lit(1)).alias("runs"))
        known = placed.join(beside(cost, "gram"), ["gram", "at", "size"]).withColumns({"place": F.row_number().over(best), "held": F.count(F.lit(1)).over(Window.partitionBy("needle"))})
        return known.where("place = 1").join(runs.hint("merge"), "needle").where("held = runs").select("gram", "at", "size").distinct()

    def _grams(self, runs: DataFrame, more: Column | None = None) -> DataFrame:
        """id, text, begin and the columns of `runs`: where the texts hold one of these (gram, each once, and `more` bytes)."""
        runs = written(runs)
        sizes = [r[0] for r in runs.select(F.char_length("gram")).distinct().collect()]
        return _runs(self.texts, "text", F.array(*[F.lit(x) for x in sizes]).cast("array<int>"), "gram", "begin").join(beside(runs, "gram", more=more), "gram")

    def candidates(self, needles: DataFrame) -> DataFrame:
        """needle and id of the texts that hold it, by their stretches; needles: needle, not empty and each once."""
        of_gram = self.ways(needles).groupBy("gram").agg(F.collect_list(F.struct("at", "size")).alias("ways"))
        begins = self._grams(of_gram, 24 * F.size("ways")).select("id", "text", "begin", F.inline("ways"))
        begin = F.col("begin") - F.col("at") + 1
        stretches = begins.where((begin >= 1) & (begin + F.col("size") - 1 <= F.char_length("text"))).select("id", F.substring("text", begin, F.col("size")).alias("needle"))
        return stretches.join(beside(needles, "needle"), "needle").select("needle", "id").distinct()

    def found(self, needles: DataFrame) -> DataFrame:
        """needle (as given) and id of every text that holds it. Needles: column `needle`; null ones find nothing, the
        empty one every text."""
        asked = written(needles.select("needle", self._folded(F.col("needle")).alias("folded")).where("needle is not null").distinct())
        held = self.candidates(asked.where("folded <> ''").select(F.col("folded").alias("needle")).distinct()).withColumnRenamed("needle", "folded")
        every = self.texts.select("id").crossJoin(F.broadcast(asked.where("folded = ''").select("needle"))).select("needle", "id")
        return held.join(beside(asked, "needle", "folded"), "folded").select("needle", "id").unionByName(every)
