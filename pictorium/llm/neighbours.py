"""Approximate nearest neighbours by multi-index hashing.

Iterative quantisation turns each vector into a binary code: TABLES rotations of the principal axes, each learnt from
another start so that signs lose least, give one bit an axis and rotation. Codes are cut into substrings of SUBSTRING
bits. `indexed` writes the index once: a row for every SEGMENT vectors, with their ids, vectors and codes and, for each
substring, the rows in the order of its value. A code within Hamming radius r of a query agrees with it up to
floor(r / m) bits in one of the m substrings at least (pigeonhole), so probing, in each substring, all values that near
retrieves every code within the radius; where the probes would visit more rows than there are, the codes are read one
by one, which retrieves the same. Those within the radius are ranked anew by exact Euclidean distances in double
precision on the original vectors.

Rotations and radius are fitted on a sample of at most FIT_ROWS vectors (the smallest hashes of vec_id); the radius is
the Hamming distance that RADIUS_SHARE of the sample's own true neighbours lie within. In all rows neighbours are no
farther apart than in the sample, so recall on the whole is at least about that share. Every row is indexed and none
is capped. A query that finds fewer than k within the radius is searched again among all rows.

Queries are asked in rounds of QUERY_BYTES of vectors, each broadcast (that is its bound) and held against all segments
at once; a task keeps the best k of each query, so k rows per query and task are shuffled. `n_ranked` of a result says
how many rows were ranked by their distance for its query, of all tasks.

Vectors that are null, empty or zero, or hold null or non-finite components, or whose length isn't the most frequent
one (ties: the smaller), take no part; nor do rows without an id. Equal distances go to the smaller vec_id. Rows that
share the query's id are never its candidates, and of repeated query ids one row is asked (the least vector). An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictorium.llm.common import written

#: Bits of a code, at least, and of a substring.
BITS, SUBSTRING = 256, 16
FIT_ROWS, FIT_QUERIES, RADIUS_SHARE = 10_000, 200, 0.97
ROTATIONS = 20
SEGMENT = 4_096
QUERY_BYTES = 32_000_000
_ONES = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint32)).astype(np.uint8)


class Codes(NamedTuple):
    mean: np.ndarray
    axes: np.ndarray
    radius: int


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = given.where("vec_id is not null and vec is not null and size(vec) > 0").where(~odd & F.exists("vec", lambda x: x != 0))
    length = fine.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("vec") == (length["d"] if length else 0))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def encode(codes: Codes, rows: np.ndarray) -> np.ndarray:
    """Substrings of each row's code, (n, m); the last one is filled up with zeros."""
    bits = (rows - codes.mean) @ codes.axes > 0
    missing = -bits.shape[1] % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, missing))), axis=1)
    return packed.view(np.uint16)


def apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hamming distances of codes to a code."""
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


def fit(sample: np.ndarray, k: int, share: float = RADIUS_SHARE) -> Codes:
    """The rotations, and the radius that holds `share` of the sample's true k nearest."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[: min(len(axes), BITS)].T
    flat = centred @ axes
    learnt = []
    for table in range(-(-BITS // axes.shape[1])):
        rotation, _ = np.linalg.qr(np.random.default_rng(3 + table).normal(size=(axes.shape[1],) * 2))
        for _ in range(ROTATIONS):
            u, _, v = np.linalg.svd(np.where(flat @ rotation > 0, 1.0, -1.0).T @ flat)
            rotation = (u @ v).T
        learnt.append(axes @ rotation)
    codes = Codes(mean, np.concatenate(learnt, axis=1), 0)
    bits = encode(codes, sample)
    near = []
    for q in range(min(FIT_QUERIES, len(sample))):
        d = distances(sample, sample[q])
        d[q] = np.inf
        best = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        near.append(apart(bits[best], bits[q]))
    every = np.sort(np.concatenate(near)) if near else np.zeros(0)
    radius = int(every[min(len(every) - 1, int(share * len(every)))]) if len(every) else codes.axes.shape[1]
    return codes._replace(radius=radius)


class Index:
    """Codes of a segment by each substring's value: `rows` in the order of the values, `values` in that order."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray | None = None):
        self.codes = codes
        self.rows = np.argsort(codes, axis=0, kind="stable").T.astype(np.uint32) if rows is None else rows
        self.values = [codes[order, j] for j, order in enumerate(self.rows)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius of this one."""
        n, m = self.codes.shape
        if radius >= SUBSTRING * m:
            return np.arange(n)
        near = _ONES[np.arange(1 << SUBSTRING, dtype=np.uint32)] <= radius // m
        probes = int(near.sum())
        if probes >= n:
            return np.flatnonzero(apart(self.codes, code) <= radius)
        masks = np.flatnonzero(near).astype(np.uint16)
        hit = np.zeros(n, bool)
        for j in range(m):
            wanted = code[j] ^ masks
            begin, end = np.searchsorted(self.values[j], wanted, "left"), np.searchsorted(self.values[j], wanted, "right")
            for b, e in zip(begin[end > begin].tolist(), end[end > begin].tolist(), strict=True):
                hit[self.rows[j][b:e]] = True
        found = np.flatnonzero(hit)
        return found[apart(self.codes[found], code) <= radius]


def nearest(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of these rows, exactly, ties to the smaller id."""
    own = ids != query_id
    ids, rows = ids[own], rows[own]
    if len(ids) > 4 * k:
        rough = (rows**2).sum(axis=1) - 2 * (rows @ query)
        limit = np.partition(rough, k - 1)[k - 1]
        close = rough <= limit + 1e-9 * (1 + abs(limit) + (query**2).sum())
        ids, rows = ids[close], rows[close]
    d = distances(rows, query)
    best = np.lexsort((ids, d))[:k]
    return ids[best], d[best]


def indexed(rows: DataFrame, codes: Codes) -> DataFrame:
    """The index, written once: a row for each segment. rows: vec_id, vec."""
    held = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(begin, SEGMENT)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                index = Index(encode(held.value, vectors))
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32()), "ids": [ids.astype(np.int64).tobytes()], "vectors": [vectors.tobytes()], "codes": [index.codes.tobytes()], "rows": [index.rows.tobytes()]})

    return written(rows.select("vec_id", "vec").mapInArrow(run, "n int, ids binary, vectors binary, codes binary, rows binary"))


def _search(index: DataFrame, codes: Codes, block: list[tuple[int, np.ndarray]], k: int, radius: int) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast((codes, [q for q, _ in block], np.stack([v for _, v in block])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, queries, vectors = held.value
        asked = encode(codes, vectors)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        ranked = np.zeros(len(queries), np.int64)
        for batch in batches:
            for segment in range(batch.num_rows):
                n, *blobs = (c[segment].as_py() for c in batch.columns)
                ids, rows = np.frombuffer(blobs[0], np.int64), np.frombuffer(blobs[1]).reshape(n, -1)
                table = Index(np.frombuffer(blobs[2], np.uint16).reshape(n, -1), np.frombuffer(blobs[3], np.uint32).reshape(-1, n))
                for q, query in enumerate(vectors):
                    found = table.within(asked[q], radius)
                    ranked[q] += len(found)
                    if len(found):
                        new, d = nearest(ids[found], rows[found], queries[q], query, k)
                        new, d = np.concatenate([best[q][0], new]), np.concatenate([best[q][1], d])
                        top = np.lexsort((new, d))[:k]
                        best[q] = new[top], d[top]
        counts = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(np.array(queries, np.int64), counts), "vec_id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best]), "n_ranked": np.repeat(ranked, counts)})

    found = index.select("n", "ids", "vectors", "codes", "rows").mapInArrow(run, "query_id long, vec_id long, score double, n_ranked long").withColumn("task", F.spark_partition_id())
    asked = Window.partitionBy("query_id")
    order = asked.orderBy("score", "vec_id")
    # each task gives its count with each of its rows: the first one of a task counts
    first = F.row_number().over(Window.partitionBy("query_id", "task").orderBy("score", "vec_id")) == 1
    counted = found.withColumn("first", first).withColumn("n_ranked", F.sum(F.when(F.col("first"), F.col("n_ranked"))).over(asked))
    placed = counted.withColumn("rank", F.row_number().over(order))
    return placed.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_ranked")


def neighbours(vectors: DataFrame, asked: Column, k: int = 10, *, share: float = RADIUS_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score and n_ranked: the k nearest found of each row that `asked` (over vec_id) picks."""
    rows = written(usable(vectors))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vec").collect()
    total = rows.count()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_ranked long")
    if total < 2:
        return empty
    codes = fit(np.array([r["vec"] for r in sample]), k, share)
    index = indexed(rows, codes)
    out, last = empty, None
    queries = rows.where(asked).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    block_rows = max(1, QUERY_BYTES // (8 * len(codes.mean)))
    while True:
        # the next round in the order of ids: the driver holds one at a time
        later = queries if last is None else queries.where(F.col("vec_id") > last)
        block = [(r["vec_id"], np.array(r["vec"])) for r in later.orderBy("vec_id").limit(block_rows).collect()]
        if not block:
            return out
        last = block[-1][0]
        found = written(_search(index, codes, block, k, codes.radius))
        enough = {r["query_id"] for r in found.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1)).collect()}
        few = [b for b in block if b[0] not in enough]
        if few:
            again = _search(index, codes, few, k, 1 << 30)
            found = found.join(F.broadcast(again.select("query_id").distinct()), "query_id", "left_anti").union(again)
        out = out.union(found)
