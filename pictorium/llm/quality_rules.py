"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every measure is a Spark SQL expression over the text alone, and `RULES` says which range each must lie in. The
compiled verdict is one boolean expression over the measures, so a caller may pass another table.

A word is a run of characters other than the six ASCII spaces. Counts are whole-text counts in code points. Repeated
five-word windows are compared by their 64-bit xxHash, chained word by word (in a text of a million words, two
different windows agree with probability below 1e-7).

Null and empty texts have no words and fail (fewer than 10 words). Ties do not arise. Repeated rows are judged one
by one, an empty table gives no rows, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.llm.common import id_and_text, opened, whole_row

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Frequent function words of the languages covered.
STOP_WORDS = "the of and to in is that it for der die das und mit von ist la le les de des et que el los en por con una un".split()


class Rule(NamedTuple):
    """`measure` must lie within [low, high]; None leaves a side open. It applies to texts of at least `words` words."""

    measure: str
    low: float | None
    high: float | None
    words: int = 0


#: The production table.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0, 20),
    Rule("symbols_per_word", None, 0.5, 10),
    Rule("stop_word_ratio", 0.01, None, 50),
    Rule("dup_line_ratio", None, 0.5, 20),
)

#: Measures that rules may name, in SQL over the counts of `measured`; one without a value (no words) holds.
MEASURES = {
    "mean_word_chars": "try_divide(word_chars, n_words)",
    "symbols_per_word": "try_divide(n_symbols, n_words)",
    "stop_word_ratio": "try_divide(n_stop_words, n_words)",
    "dup_line_ratio": "try_divide(n_dup_lines, n_lines)",
}


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one expression: true where every rule that applies holds."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.expr(MEASURES[rule.measure])
        holds = F.lit(True)
        if rule.low is not None:
            holds &= value >= rule.low
        if rule.high is not None:
            holds &= value <= rule.high
        verdict &= (F.col("n_words") < max(rule.words, 1)) | F.coalesce(holds, F.lit(True))
    return verdict


def _repeated_words(windows: Column) -> Column:
    """Words inside windows (given by hashes, in order) that occur at least twice."""

    def count(pairs: Column) -> Column:
        """pairs: (hash, position), sorted."""
        near = lambda i, step: F.get(pairs, i + step)["h"]
        found = F.filter(pairs, lambda x, i: F.coalesce(near(i, -1) == x["h"], F.lit(False)) | F.coalesce(near(i, 1) == x["h"], F.lit(False)))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, at: F.struct(at.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("total"))
        return F.aggregate(F.array_sort(F.transform(found, lambda x: x["i"])), start, step)["total"]

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    bound = F.element_at(F.transform(F.array(pairs), count), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bound)


def measured(docs: DataFrame, *, whole: bool = False) -> DataFrame:
    """doc_id and the counts of every text, in one chain of projections over the scan; `whole` keeps the row as `row`."""
    text = F.col("text")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), whole_row(docs).alias("row")) if whole else id_and_text(docs)
    kept = ["doc_id", "row"] if whole else ["doc_id"]
    plain = given.select(
        *kept,
        F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.char_length(F.translate(text, SPACES + " ", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    shifted = [F.slice("words", k + 1, F.greatest(F.size("words") - WINDOW + 1, F.lit(0))).alias(f"w{k}") for k in range(WINDOW)]
    zipped = plain.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.arrays_zip(*shifted).alias("zipped"),
    )
    hashed = zipped.withColumn("windows", F.transform("zipped", lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(WINDOW)])))
    counts = hashed.withColumn("n_repeat_words", _repeated_words(F.col("windows")).cast("long"))
    return counts.drop("zipped", "windows")


def _judged(counts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, base_failed (too few words, or too many of them in repeated windows) and kept for every text."""
    return _judged(measured(docs), rules)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that are kept, with all their columns.

    A plain filter would be pushed below the projections and work out every measure again in its own expression. A row
    number, which has no fixed value, keeps the filter above them.
    """
    judged = _judged(measured(docs, whole=True), rules).select("row", "kept", F.monotonically_increasing_id().alias("number"))
    return judged.where(F.col("kept") & (F.col("number") >= 0)).select(*opened(F.col("row"), docs.columns))
