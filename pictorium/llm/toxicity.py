"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in NumPy.

A text is a bag of features: its words (lower case, runs of letters and digits, also those with signs in between
that stand in for letters) and their character n-grams, between word-end marks, hashed into BUCKETS rows of an
embedding. The mean of the rows goes through a linear softmax over two classes. Embeddings and softmax are trained
together; an unseen misspelling shares n-grams with what it stands for, and so its vector.

Training takes at most `max_rows` labelled texts of each class (those whose ids have the smallest hashes, so the choice
doesn't depend on the layout), turned into bags on the executors; only the bags reach the driver, each whole, with at
most BUCKETS different features, and of each class as many of them, in that order, as fit half of `max_bytes`. Labels, languages, sources and ids are no inputs. Scoring covers all texts wholly: as the model
is linear in the bag, each word's share of the two logits is worked out once per worker and summed.

Null and empty texts have an empty bag and get the score of the bias alone. Rows with a null id are scored and count
as not held out; repeated rows are scored alike, and of rows with one id the least text is learnt from. Labels that are null are not used; a label repeated for one id counts
once, 1 before 0. Without labelled rows, or with one class only, every score is the share of that class (0.5 without
any). Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.llm.common import BoundedCache, id_and_text, slices, written

BUCKETS, DIM = 1 << 16, 8
SHORTEST, LONGEST = 3, 6
MAX_ROWS, MAX_BYTES = 3_000, 300_000_000
STEPS, BATCH, RATE = 750, 32, 0.02
#: Memory of a worker's table of words.
CACHE_BYTES = 64_000_000
WORD = re.compile(r"[^\W_]+(?:[@$!*.\-'][^\W_]+)*")
_SEED, _PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


class Model(NamedTuple):
    """embedding @ softmax, the two classes' difference per bucket, and the bias; `constant` replaces all if given."""

    share: np.ndarray
    bias: float
    constant: float | None = None


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, one word after another, and how many each word has."""
    marked = [f"<{w}>" for w in parts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(marked)), size)
    place = np.arange(len(points))
    hashes, owners = [], []
    rolling = np.full(len(points), _SEED)
    for n in range(1, LONGEST + 1):
        rolling = (rolling[: len(points) - n + 1] ^ points[n - 1 :]) * _PRIME
        if n >= SHORTEST and len(rolling):
            inside = place[: len(rolling)] + n <= ends[: len(rolling)]
            hashes.append(rolling[inside] + np.uint64(n))
            owners.append(owner[: len(rolling)][inside])
    # the word itself: a sum over its characters by position, mixed
    at = place - (ends - np.repeat(size, size))
    whole = np.zeros(len(marked), np.uint64)
    np.add.at(whole, owner, (points + _SEED) * (_PRIME ** (at % 64).astype(np.uint64)))
    hashes.append(whole * _PRIME)
    owners.append(np.arange(len(marked)))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    order = np.argsort(o, kind="stable")
    return (h[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(o, minlength=len(marked))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and how often each occurs."""
    parts = words(text)
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    b, n = np.unique(features(parts)[0], return_counts=True)
    return b.astype(np.int32), n.astype(np.float32)


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("size", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])
    for part in slices(batches):
        found = [bag(t) for t in part["text"]]
        yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "label": part["label"], "size": [8 * len(b) for b, _ in found], "buckets": [b.tobytes() for b, _ in found], "counts": [c.tobytes() for _, c in found]}, schema)


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], share: float | None = None, *, seed: int = 1) -> Model:
    """Adam on the cross-entropy of a softmax over the mean embedding, in some STEPS steps whatever the number of rows.

    share: of class 1 among all labelled rows, which the classes are weighted to; by default as they are.
    """
    bags = [b for b in bags if len(b[1])]
    labels = np.array([y for y, _, _ in bags], np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(0), 0.0, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    own = np.bincount(labels, minlength=2) / len(labels)
    weight = np.ones(2) if share is None else np.array([1 - share, share]) / own
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (embed, soft, bias)]
    step = 0
    for _ in range(-(-STEPS * BATCH // len(bags))):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = [bags[i] for i in order[at : at + BATCH]]
            y = np.array([c[0] for c in chosen])
            size = np.array([len(c[1]) for c in chosen])
            column = np.concatenate([c[1] for c in chosen])
            value = np.concatenate([c[2] / c[2].sum() for c in chosen]).astype(np.float32)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            mean = np.add.reduceat(embed[column] * value[:, None], starts, axis=0)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[y] / len(y))[:, None].astype(np.float32)
            back = p @ soft.T
            row = np.repeat(np.arange(len(y)), size)
            used, where = np.unique(column, return_inverse=True)
            grad = np.stack([np.bincount(where, value * back[row, d], len(used)) for d in range(DIM)], axis=1).astype(np.float32)
            step += 1
            for k, (param, g, rows) in enumerate(((embed, grad, used), (soft, mean.T @ p, slice(None)), (bias, p.sum(axis=0), slice(None)))):
                first, second = state[k]
                first[rows] = 0.9 * first[rows] + 0.1 * g
                second[rows] = 0.99 * second[rows] + 0.01 * g * g
                param[rows] -= RATE * (first[rows] / (1 - 0.9**step)) / (np.sqrt(second[rows] / (1 - 0.99**step)) + 1e-6)
    # only the difference of the two logits matters
    return Model((embed @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def labelled_bags(docs: DataFrame, labels: DataFrame, allowed: Column, max_rows: int, max_bytes: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], float | None]:
    """Bags of at most max_rows labelled texts of each class, max_bytes in all, and the share of class 1 among all labels. allowed: which ids may be learnt from, over the column doc_id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(allowed).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    texts = id_and_text(docs).where("doc_id is not null")
    # the choice is made among ids; only the chosen texts move
    classes = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    chosen = classes[0].union(classes[1])
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = written(once.mapInArrow(_bags, "doc_id long, label int, size long, buckets binary, counts binary"))
    kept, held = [], {0: 0, 1: 0}
    for r in rows.select("doc_id", "label", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # two times max_rows at most
        held[r["label"]] += r["size"]
        if held[r["label"]] <= max_bytes // 2:
            kept.append((r["doc_id"],))
    within = rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long")), "doc_id")
    found = [(r["label"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in within.toLocalIterator()]
    # training sees the same order however the rows came
    return sorted(found, key=lambda b: (b[0], len(b[1]), b[1].tobytes(), b[2].tobytes())), share


def fitted(docs: DataFrame, labels: DataFrame, allowed: Column, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    return train(*labelled_bags(docs, labels, allowed, max_rows, max_bytes))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, bias, constant = held.value
        cache = BoundedCache(CACHE_BYTES, 1.5)
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for part in slices(batches):
            scores = []
            for text in part["text"]:
                if constant is not None:
                    scores.append(constant)
                    continue
                parts = words(text)
                new = cache.absent(set(parts))
                if new:
                    buckets, n = features(new)
                    sums = np.add.reduceat(share[buckets], np.concatenate([[0], np.cumsum(n)[:-1]]))
                    cache.update(zip(new, zip(sums.tolist(), n.tolist(), strict=True), strict=True))
                logit, count = 0.0, 0
                if parts:
                    sums, counts = zip(*[cache[w] for w in parts], strict=True)
                    logit, count = sum(sums), sum(counts)
                scores.append(1 / (1 + float(np.exp(-np.clip(logit / max(count, 1) + bias, -500, 500)))))
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "score": scores}, schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")
