"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The token weight of each cell is raked: in turn, for each
dimension, the cells' weights are multiplied so that the dimension's shares meet its targets, until no share is off
by more than TOLERANCE. Raked over own tokens is a cell's factor; its documents are kept with the probability
min(1, scale * factor), where the scale makes the tokens expected to stay the share `keep` of all. A kept document's
weight, factor over probability, makes up for what sampling alone can't (categories that would need repeating), so
weighted tokens meet the targets in expectation. A document's draw is fixed by a hash of its id and a seed, so a rerun
after a lost executor decides alike.

Targets are stated per dimension: category -> share. A category without a target of its own falls into OTHER; if
OTHER has no target, it keeps the share it has. A target category without any document can't be met: its share is
spread over the others. TEMPERED asks for shares that follow the power TEMPER of each category's own tokens, for every
category, however many there are. Cells of at most DRIVER_CELLS are raked on the driver; more of them stay a table,
raked by aggregates and joins, in the same turns, to the same tolerance and by the same rule. Targets that contradict
each other (cells that would be needed hold nothing) are never met at once: after ROUNDS rounds the weights are those of
the last dimension, and a warning says how far off the others are.

Tokens are the caller's counts where `tokens` names a column, else words (runs of characters other than the six ASCII
spaces); a document without any weighs nothing and is kept with its cell's probability. Topics are the caller's where
`topic` names a column, else what kind of text it is, by the first of the patterns of TOPICS. Null text counts as empty, a null category as the category `null`; null ids draw
by the text in place of the id. Repeated rows draw alike. Ties in the number of tokens are broken by name. An empty
table gives no rows, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.llm.common import column, opened, whole_row, word_count, written

OTHER = "other categories"
TEMPERED = "tempered"
TEMPER = 0.7
KEEP = 0.9
DRIVER_CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
TOLERANCE, ROUNDS = 1e-9, 1_000
SEED = 20240517

#: Topics by what a text holds: the first pattern that it matches, in this order.
TOPICS = {
    "tables": r"\|[^\n|]+\|[^\n|]+\|",
    "licences": r"(?i)\b(copyright|licen[cs]e|all rights reserved|warranty)\b",
    "contacts": r"@[A-Za-z0-9-]+\.|\+[0-9][ ().0-9-]{6}",
    "figures": r"[0-9]{4}",
}
#: The production targets: sources evened out, these shares of the languages, and prose for the greater part.
TARGETS: Mapping[str, Mapping[str, float] | str] = {
    "source": TEMPERED,
    "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15},
    "topic": {"prose": 0.7, "tables": 0.1, "licences": 0.05, "contacts": 0.05, "figures": 0.1},
}


def topic(text: Column) -> Column:
    out = F.when(F.length(text) == 0, F.lit("prose"))
    for name, pattern in TOPICS.items():
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("prose"))


def described(docs: DataFrame, *, tokens: str | None = None, topics: str | None = None) -> DataFrame:
    """The row, doc_id, the three categories, n_tokens and the draw (0 to 1) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.sha2(text, 256)), F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    named = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    count = word_count(text) if tokens is None else F.greatest(F.coalesce(column(tokens).cast("long"), F.lit(0)), F.lit(0))
    kind = topic(text) if topics is None else named(column(topics))
    return docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), named(F.col("source")).alias("source"), named(F.col("lang")).alias("lang"), kind.alias("topic"), count.alias("n_tokens"), draw.alias("draw"))


def _bucket(name: str, wanted: Mapping[str, float] | str) -> Column:
    return F.col(name) if wanted == TEMPERED else F.when(F.col(name).isin(list(wanted)), F.col(name)).otherwise(F.lit(OTHER))


def tempered(names: np.ndarray, tokens: np.ndarray) -> dict[str, float]:
    """Targets that follow the power TEMPER of the categories' tokens."""
    found, at = np.unique(names, return_inverse=True)
    sums = np.bincount(at, tokens, len(found))
    return {str(n): float(t) ** TEMPER for n, t in zip(found, sums, strict=True) if t > 0}


def raked(cells: np.ndarray, weights: np.ndarray, targets: list[dict[str, float]]) -> np.ndarray:
    """Weights that meet the targets in each dimension. cells: (n, d) categories; weights: tokens of each cell."""
    w = weights.astype(float).copy()
    total = w.sum()
    if not total:
        return w
    aims = []
    for d, share in enumerate(targets):
        names, at = np.unique(cells[:, d], return_inverse=True)
        now = np.bincount(at, weights, len(names)) / total
        goal = np.array([share.get(str(n), now[k] if n == OTHER else 0.0) if now[k] > 0 else 0.0 for k, n in enumerate(names)])
        stated = np.array([str(n) in share for n in names])
        left = 1 - goal[~stated].sum()
        if goal[stated].sum():
            goal[stated] *= left / goal[stated].sum()
        goal /= goal.sum() or 1
        aims.append((at, goal))
    for _ in range(ROUNDS):
        worst = 0.0
        for at, goal in aims:
            now = np.bincount(at, w, len(goal)) / w.sum()
            worst = max(worst, np.abs(now - goal).max())
            w *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at]
        if worst < TOLERANCE:
            break
    else:
        _unmet(worst)
    return w * (total / w.sum())


def _unmet(worst: float) -> None:
    warnings.warn(f"the targets contradict each other: after {ROUNDS} rounds a share is off by {worst:.2g}", stacklevel=3)


def scale(tokens: np.ndarray, factor: np.ndarray, keep: float) -> float:
    """The scale at which the tokens expected to stay are the share `keep` (or all that can be, if that is less)."""
    low, high = 0.0, 1.0 / min(factor[factor > 0], default=1.0)
    for _ in range(100):
        middle = (low + high) / 2
        if (tokens * np.minimum(1, middle * factor)).sum() < keep * tokens.sum():
            low = middle
        else:
            high = middle
    return high


def _raked_table(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | str], keep: float) -> DataFrame:
    """As on the driver, for cells that outgrow it: cells with weight and probability. cells: one column a dimension, n."""
    total = cells.agg(F.sum("n")).first()[0] or 0
    if not total:
        return cells.select(*_CELLS, F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    goals = {}
    for name, cell in zip(DIMENSIONS, _CELLS, strict=True):
        sums = cells.groupBy(cell).agg(F.sum("n").cast("double").alias("n"))
        stated = F.when(F.col("n") > 0, F.pow("n", F.lit(TEMPER)))
        if targets[name] != TEMPERED:
            stated = F.lit(None).cast("double")
            for category, share in targets[name].items():
                stated = F.when((F.col(cell) == category) & (F.col("n") > 0), F.lit(float(share))).otherwise(stated)
        own = sums.withColumn("stated", stated).withColumn("rest", F.when(F.col("stated").isNull() & (F.col(cell) == OTHER), F.col("n") / total).otherwise(0.0))
        whole = own.agg(F.sum("stated").alias("s"), F.sum("rest").alias("r")).first()
        left = (1 - whole["r"]) / whole["s"] if whole["s"] else 0.0
        goals[cell] = written(own.select(cell, (F.coalesce(F.col("stated") * left, F.lit(0.0)) + F.col("rest")).alias("goal")))
    now = written(cells.select(*_CELLS, "n", F.col("n").cast("double").alias("w")))
    for _ in range(ROUNDS):
        worst = 0.0
        for cell in _CELLS:
            held = now.groupBy(cell).agg(F.sum("w").alias("has")).join(goals[cell], cell)
            sums = written(held.withColumn("all", F.lit(now.agg(F.sum("w")).first()[0])).withColumn("share", F.col("has") / F.col("all")))
            worst = max(worst, sums.agg(F.max(F.abs(F.col("share") - F.col("goal")))).first()[0])
            ratio = F.coalesce(F.try_divide(F.col("goal"), F.col("share")), F.lit(0.0))
            now = written(now.join(sums.select(cell, ratio.alias("ratio")), cell).select(*_CELLS, "n", (F.col("w") * F.col("ratio")).alias("w")))
        if worst < TOLERANCE:
            break
    else:
        _unmet(worst)
    whole = now.agg(F.sum("w")).first()[0]
    factors = written(now.withColumn("factor", F.coalesce(F.try_divide(F.col("w") * (total / whole), F.col("n")), F.lit(0.0))))
    low, high = 0.0, 1.0 / (factors.where("factor > 0").agg(F.min("factor")).first()[0] or 1.0)
    for _ in range(50):
        middle = (low + high) / 2
        kept = factors.agg(F.sum(F.col("n") * F.least(F.lit(1.0), F.col("factor") * middle))).first()[0]
        low, high = (middle, high) if kept < keep * total else (low, middle)
    chance = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("factor") * high)).otherwise(1.0)
    return factors.select(*_CELLS, F.coalesce(F.try_divide(F.col("factor"), chance), F.lit(0.0)).alias("weight"), chance.alias("probability"))


_CELLS = tuple(f"{name}_cell" for name in DIMENSIONS)


def _decided(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | str], keep: float, *, tokens: str | None = None, topics: str | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    rows = described(docs, tokens=tokens, topics=topics)
    cut = rows.withColumns({cell: _bucket(name, targets[name]) for name, cell in zip(DIMENSIONS, _CELLS, strict=True)})
    # one pass over the texts gives the cells; the second one needs each document's cell alone
    cells = written(cut.groupBy(*_CELLS).agg(F.sum("n_tokens").alias("n")))
    if cells.count() > driver_cells:
        return cut.join(_raked_table(cells, targets, keep), list(_CELLS), "left").withColumn("kept", F.col("draw") < F.col("probability"))
    found = cells.orderBy(*_CELLS).collect()
    counts = np.array([r["n"] for r in found], float)
    names = np.array([[r[c] for c in _CELLS] for r in found], object).astype(str).reshape(-1, len(_CELLS))
    aims = [tempered(names[:, k], counts) if targets[d] == TEMPERED else dict(targets[d]) for k, d in enumerate(DIMENSIONS)]
    new = raked(names, counts, aims)
    factor = np.divide(new, counts, out=np.zeros_like(new), where=counts > 0)
    chance = np.where(counts > 0, np.minimum(1, scale(counts, factor, keep) * factor), 1.0)
    weight = np.divide(factor, chance, out=np.zeros_like(factor), where=chance > 0)
    schema = ", ".join(f"{c} string" for c in _CELLS) + ", weight double, probability double"
    shares = docs.sparkSession.createDataFrame([(*(r[c] for c in _CELLS), float(w), float(p)) for r, w, p in zip(found, weight, chance, strict=True)], schema)
    return cut.join(F.broadcast(shares), list(_CELLS), "left").withColumn("kept", F.col("draw") < F.col("probability"))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | str] = TARGETS, keep: float = KEEP, **more) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and kept, for every document. `tokens`, `topics`: names
    of columns that hold counts and topics already."""
    return _decided(docs, targets, keep, **more).select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "kept")


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | str] = TARGETS, keep: float = KEEP, **more) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return _decided(docs, targets, keep, **more).where("kept").select(*opened(F.col("row"), docs.columns))
