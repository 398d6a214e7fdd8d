"""The nearest known vectors of each asked one, exactly, without meeting blocks that can't hold any of them.

Vectors lie in blocks around pivots. A block knows, for each pivot, the least and greatest distance of its vectors to
it. By the triangle inequality two blocks that lie in distant rings around some pivot are at least the rings' gap
apart. A block of asked vectors meets the known blocks one after another, nearest first, and passes over those that no
person can need any more: whose gap is beyond the worst of the k-th distances found so far.

Each known block is a file in the shared folder, which a task reads when its asked block comes to it. So only the asked
vectors are shuffled, once; what is found for an asked block is whole when its task is done, and nothing is merged
afterwards. Memory is that of two blocks, what is kept for the asked one, and BROADCAST_NUMBERS of known vectors.

Gaps come from a table of the blocks' extents alone, a row a block, which is compared in chunks. Where vectors have
no structure (random ones of many dimensions) nothing can be skipped and all pairs of blocks meet.

Two measures: Euclidean distance, and the negated cosine, which orders unit vectors as their distance does. Pivots are
centres of a bounded sample (PIVOT_SAMPLE rows by the hash of their ids); any choice gives the same rows. Vectors that are null, the sentinel, or hold null or
non-finite components take no part, neither do known vectors without a person, and for the cosine zero vectors; those of another length than any known one meet nobody.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pictorium.config import NO_ENCODING
from pictorium.functions.scorers import Scorer
from pictorium.sources.shared import written

#: Vectors of a block on either side: a pair of blocks is one matrix product.
FACE_BLOCK, GALLERY_BLOCK = 512, 2_048
#: Of the known vectors that a task has read it keeps so many numbers (8 bytes each) for its further asked blocks.
BROADCAST_NUMBERS = 4_000_000
#: Numbers that a task holds at once for the ends of the similarities of some asked vectors.
ENDS_NUMBERS = 8_000_000
PIVOTS, PIVOT_SAMPLE = 64, 4_096
#: Extents that are compared with an asked block's at once, and pairs of vectors whose differences are held at once.
CHUNK, DIFFERENCES = 256, 65_536
#: Bounds are sums of rounded numbers: what is within this of a bound counts as within it.
SLACK = 1e-9

NEAR = "array<struct<v: double, id: bigint>>"
WANTED = "array<struct<least: double, most: double, b: bigint, people: array<bigint>>>"
PERCENTILES = "face_id long, person_id long, n long, p array<double>"


def usable(vector: Column) -> Column:
    """Neither null nor the sentinel."""
    return vector.isNotNull() & (F.get(vector, F.lit(0)) != NO_ENCODING)


def finite(vector: Column) -> Column:
    """All components are numbers other than infinite ones."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(rows: pa.StructArray, field: str) -> np.ndarray:
    """A field of structs as an array; vectors as a matrix."""
    values = rows.field(field)
    if pa.types.is_list(values.type):
        return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
    return values.to_numpy(zero_copy_only=False)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, by the expansion of the square: good to some 1e-7 of the vectors' lengths."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Blocks(NamedTuple):
    """Packed vectors: `table` has block, lo, hi (distances to each pivot), owners (person_id and n, of known ones) and rows."""

    pivots: np.ndarray
    table: DataFrame
    cosine: bool


class Found(NamedTuple):
    """face_id, person_id, `of` (vectors of the person), near (v and id, nearest first), or n and p; pairs of blocks that met, and all."""

    rows: DataFrame
    met: int
    pairs: int


def prepared(vectors: DataFrame, *more: str, cosine: bool) -> DataFrame:
    """id, further columns and vec (doubles) of the vectors that take part."""
    rows = vectors.select("id", *more, F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.where(usable(F.col("vec")) & finite(F.col("vec")) & (F.size("vec") > 0))
    return rows.where(F.exists("vec", lambda x: x != 0)) if cosine else rows


def chosen_pivots(known: DataFrame, n: int, cosine: bool) -> np.ndarray:
    """Farthest-first centres of a sample, moved to the middle of what lies around them: two for each block of known vectors, PIVOTS at most,
    and one if a block holds them all."""
    sample = known.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).toArrow()
    vectors = matrix(pa.StructArray.from_arrays([sample.column("vec").combine_chunks()], ["vec"]), "vec")
    if cosine:
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = vectors[:1]
    away = distances(vectors, out)[:, 0]
    for _ in range(min(PIVOTS, -(-2 * n // GALLERY_BLOCK)) - 1 if n > GALLERY_BLOCK else 0):
        at = int(away.argmax())
        if away[at] <= 0:
            break
        out = np.vstack([out, vectors[at]])
        away = np.minimum(away, distances(vectors, out[-1:])[:, 0])
    for _ in range(3):
        home = distances(vectors, out).argmin(axis=1)
        out = np.vstack([vectors[home == k].mean(axis=0) if (home == k).any() else out[k] for k in range(len(out))])
    return out


def located(rows: DataFrame, pivots: np.ndarray, cosine: bool) -> DataFrame:
    """The rows with `home`, the nearest pivot; for the cosine, vectors come back with length one."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("vec")
            vectors = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if cosine:
                vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            home = distances(vectors, held.value).argmin(axis=1) if batch.num_rows else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, max(held.value.shape[1], 1), dtype=np.int32), vectors.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists, *batch.columns[at + 1 :], pa.array(home, pa.int32())], [*batch.schema.names, "home"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("home", IntegerType())]))


def packed(rows: DataFrame, pivots: np.ndarray, owned: bool) -> DataFrame:
    """Located rows with `block`, gathered by it, and each block's extent; `owned`: with the persons of its rows."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)
    fields = [c for c in (*(("person_id",) if owned else ()), "id", "vec", "rejected_ids") if c in rows.columns]
    cells = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = pa.list_(pa.struct([("person_id", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            lo, hi, owners = [], [], []
            for k in range(batch.num_rows):
                inside = batch.column(1)[k].values
                vectors = matrix(inside, "vec")
                away = distances(vectors, held.value)
                error = 1e-6 * (np.linalg.norm(vectors, axis=1).max() + np.linalg.norm(held.value, axis=1).max())
                lo.append(np.maximum(away.min(axis=0) - error, 0))
                hi.append(away.max(axis=0) + error)
                people, counts = np.unique(matrix(inside, "person_id"), return_counts=True) if owned else ((), ())
                owners.append([{"person_id": int(p), "n": int(c)} for p, c in zip(people, counts, strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lo, pa.list_(pa.float64())), pa.array(hi, pa.list_(pa.float64())), pa.array(owners, owner)], ["block", "rows", "lo", "hi", "owners"])

    more = StructType.fromDDL("lo array<double>, hi array<double>, owners array<struct<person_id: bigint, n: bigint>>")
    return cells.mapInArrow(run, StructType([*cells.schema.fields, *more.fields]))


def block_numbers(rows: DataFrame, size: int) -> dict[int, int]:
    """How many blocks the rows around each pivot are dealt to; PIVOTS rows at most reach the driver."""
    return {r["home"]: -(-r["count"] // size) for r in rows.groupBy("home").count().collect()}


def dealt(rows: DataFrame, parts: dict[int, int], key: Column) -> DataFrame:
    """Rows with their block: the pivot, and one of its parts by the hash of a key."""
    n = F.coalesce(F.get(F.array(*[F.lit(parts.get(k, 1)) for k in range(max(parts, default=0) + 1)]), F.col("home")), F.lit(1))
    return rows.withColumn("block", F.col("home").cast("long") * F.lit(1 << 32) + F.pmod(key, n)).drop("home")


def by_owner(rows: DataFrame) -> Column:
    """A key that keeps a person's vectors together, in as few parts of about a block as they fill."""
    return F.xxhash64("person_id") + F.coalesce(F.pmod(F.xxhash64("id"), F.col("spread")), F.lit(0))


def blocks_of(known: DataFrame, cosine: bool) -> Blocks | None:
    """Known vectors of one length (id, person_id, vec) in blocks, written to the shared folder; None if there are none."""
    n = known.count()
    if not n:
        return None
    pivots = chosen_pivots(known, n, cosine)
    rows = written(located(known, pivots, cosine))
    # a person's vectors around a pivot that fill more than a block: no more of them than there are blocks
    large = rows.groupBy("home", "person_id").count().where(F.col("count") > GALLERY_BLOCK).select("home", "person_id", F.ceil(F.col("count") / GALLERY_BLOCK).alias("spread"))
    spread = rows.join(F.broadcast(large), ["home", "person_id"], "left")
    cut = dealt(spread, block_numbers(rows, GALLERY_BLOCK), by_owner(rows))
    return Blocks(pivots, written(packed(cut, pivots, True)), cosine)


def asked_blocks(asked: DataFrame, pivots: np.ndarray, cosine: bool) -> DataFrame:
    rows = written(located(asked, pivots, cosine))
    return written(packed(dealt(rows, block_numbers(rows, FACE_BLOCK), F.xxhash64("id")), pivots, False))


def extents(asked: DataFrame, known: DataFrame) -> DataFrame:
    """a, b, least, most: bounds of the distances between each asked block's vectors and each known block's."""
    chunks = max(1, -(-known.count() // CHUNK))
    there = known.select(F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"), "block", "lo", "hi").groupBy("chunk").agg(F.collect_list(F.struct("block", "lo", "hi")).alias("there"))
    here = asked.select("block", "lo", "hi").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                others = batch.column(3)[k].values
                lo, hi, lows, highs = np.array(batch.column(1)[k].values), np.array(batch.column(2)[k].values), matrix(others, "lo"), matrix(others, "hi")
                gap = np.maximum(np.maximum(lows - hi, lo - highs), 0).max(axis=1)
                yield pa.RecordBatch.from_pydict({"a": np.full(len(gap), batch.column(0)[k].as_py()), "b": matrix(others, "block"), "least": gap, "most": (highs + hi).min(axis=1)})

    return here.join(there, "chunk").select("block", "lo", "hi", "there").mapInArrow(run, "a long, b long, least double, most double")


def kept_ends(percentiles: Sequence[float], of: int) -> tuple[int, int]:
    """How many of the least and of the greatest of so many numbers the percentiles can lie in."""
    low = max((int(p * (of - 1)) + 2 for p in percentiles if p < 0.5), default=0)
    high = max((of - int(p * (of - 1)) for p in percentiles if p >= 0.5), default=0)
    return min(low, of), min(high, of)


class Known:
    """A block of known vectors, a person's together: people, `of` (all vectors of each), where each one's begin and end."""

    def __init__(self, file: str):
        system, path = FileSystem.from_uri(file)
        with system.open_input_file(path) as source:
            row = pq.read_table(source)
        owners, self.ids, self.of = (row.column(c)[0].values.to_numpy() for c in ("person_id", "id", "of"))
        self.vectors = np.frombuffer(row.column("vec")[0].as_py()).reshape(len(owners), -1)
        starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        self.people, self.starts, self.ends = owners[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(owners)]

    def some(self, wanted: Sequence[int]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """Vectors and ids of some people, and of each: person, `of`, begin and end."""
        sizes = np.array([self.ends[g] - self.starts[g] for g in wanted])
        ends = np.cumsum(sizes)
        parts = [(self.people[g], int(self.of[g]), int(e - n), int(e)) for g, n, e in zip(wanted, sizes, ends, strict=True)]
        if len(wanted) == len(self.people):
            return self.vectors, self.ids, parts
        rows = np.concatenate([np.arange(self.starts[g], self.ends[g]) for g in wanted])
        return self.vectors[rows], self.ids[rows], parts


class Asked:
    """Some asked vectors, and how far from them each person's (or, with `best`, anybody's) vectors can still matter."""

    def __init__(self, faces: pa.StructArray, cosine: bool, best: bool = False):
        self.ids, self.vectors, self.cosine, self.best = matrix(faces, "id"), matrix(faces, "vec"), cosine, best
        self.reach: dict[int, float] = {}
        self.nearest = np.full(len(self.ids), np.inf)
        self.refusing: dict[int, np.ndarray] = {}
        if "rejected_ids" in [f.name for f in faces.type]:
            lists = faces.field("rejected_ids")
            face = np.repeat(np.arange(len(self.ids)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
            for i, p in zip(face.tolist(), lists.flatten().to_pylist(), strict=True):
                if p is not None:
                    self.refusing.setdefault(p, np.zeros(len(self.ids), bool))[i] = True

    def needs(self, least: float, person: int) -> bool:
        far = self.apart(self.nearest.max()) if self.best else self.reach.get(person, np.inf)
        return least <= far * (1 + SLACK) + SLACK

    def apart(self, value: float) -> float:
        """A distance; the cosine's from what it is ordered by."""
        return np.sqrt(max(2 + 2 * value, 0)) if self.cosine else value

    def reached(self, person: int, kth: np.ndarray) -> None:
        """A person's k-th of each asked vector (infinite: not so many yet)."""
        held = kth[~self.refusing[person]] if person in self.refusing else kth
        self.reach[person] = self.apart(held.max()) if len(held) else -1.0


class Lists(Asked):
    """The `keep` nearest of each person, as lists."""

    def __init__(self, faces: pa.StructArray, keep: int, cosine: bool, others_only: bool, best: bool):
        super().__init__(faces, cosine, best)
        self.keep, self.others_only = keep, others_only
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.of: dict[int, int] = {}
        self.kth: dict[int, np.ndarray] = {}

    def meet(self, known: Known, wanted: Sequence[int]) -> None:
        others, other_ids, parts = known.some(wanted)
        if self.cosine:
            score, near_by = -(self.vectors @ others.T), 1e-12
        else:
            lengths = (self.vectors * self.vectors).sum(axis=1)[:, None], (others * others).sum(axis=1)
            score = self.vectors @ others.T
            score *= -2
            score += lengths[0]
            score += lengths[1]
            near_by = 1e-12 * (lengths[0].max() + lengths[1].max())
        if self.others_only:
            score[self.ids[:, None] == other_ids] = np.inf
        for person, of, begin, end in parts:
            part = score[:, begin:end]
            if person in self.refusing:
                part[self.refusing[person]] = np.inf
            limit = self.kth.get(person)
            limit = np.full(len(part), np.inf) if limit is None else limit if self.cosine else limit * limit
            if not (sure := np.isfinite(limit).all()) and end - begin > self.keep:
                limit = np.minimum(limit, np.partition(part, self.keep - 1, axis=1)[:, self.keep - 1])
            chosen = part <= (limit + near_by)[:, None]
            if not sure:
                chosen &= np.isfinite(part)
            i, j = np.nonzero(chosen)
            if len(i):
                self._add(person, of, i, self._values(part, i, j, others[begin:end]), other_ids[begin:end][j])

    def _values(self, part: np.ndarray, i: np.ndarray, j: np.ndarray, others: np.ndarray) -> np.ndarray:
        value = part[i, j]
        if not self.cosine:
            for at in range(0, len(i), DIFFERENCES):
                apart = self.vectors[i[at : at + DIFFERENCES]] - others[j[at : at + DIFFERENCES]]
                value[at : at + DIFFERENCES] = np.sqrt((apart * apart).sum(axis=1))
        return value

    def _add(self, person: int, of: int, i: np.ndarray, value: np.ndarray, other: np.ndarray) -> None:
        if person in self.found:
            i, value, other = (np.concatenate(x) for x in zip(self.found[person], (i, value, other), strict=True))
        order = np.lexsort((other, value, i))
        i, value, other = i[order], value[order], other[order]
        begins = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        nth = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
        left, last = nth < self.keep, nth == self.keep - 1
        kth = np.full(len(self.ids), np.inf)
        kth[i[last]] = value[last]
        self.nearest[i[begins]] = np.minimum(self.nearest[i[begins]], value[begins])
        self.found[person], self.of[person], self.kth[person] = (i[left], value[left], other[left]), of, kth
        self.reached(person, kth)

    def results(self) -> Iterator[pa.RecordBatch]:
        for person, (i, value, other) in self.found.items():
            heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            near = pa.ListArray.from_arrays(pa.array(np.append(heads, len(i)), pa.int32()), pa.StructArray.from_arrays([pa.array(value, pa.float64()), pa.array(other, pa.int64())], ["v", "id"]))
            same = lambda x: pa.array(np.full(len(heads), x), pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[i[heads]], pa.int64()), same(person), same(self.of[person]), near], ["face_id", "person_id", "of", "near"])


class Ends(Asked):
    """Percentiles (linear between ranks) of the similarities to each person's vectors, or (`total`) to all that aren't refused.

    Kept are the ends that they can lie in: the least similarities, and the greatest with their signs turned.
    """

    def __init__(self, faces: pa.StructArray, percentiles: Sequence[float], measure: Scorer, total: int | None = None):
        super().__init__(faces, True)
        self.percentiles, self.measure, self.total = percentiles, measure, total
        #: by person (None for all): their vectors, those that a face meets, and the ends as parts, low and high
        self.of: dict[int | None, int] = {}
        self.n: dict[int | None, np.ndarray] = {}
        self.parts: dict[tuple[int | None, int], list[np.ndarray]] = {}

    def meet(self, known: Known, wanted: Sequence[int]) -> None:
        others, _, parts = known.some(wanted)
        similar = self.measure(self.vectors, others)
        gone = np.zeros(similar.shape, bool) if any(p in self.refusing for p, *_ in parts) else None
        for person, _, begin, end in parts:
            if person in self.refusing:
                gone[self.refusing[person], begin:end] = True
        for key, of, begin, end in parts if self.total is None else [(None, self.total, 0, len(others))]:
            self.of[key] = of
            out = None if gone is None else gone[:, begin:end]
            self.n[key] = self.n.get(key, np.zeros(len(self.ids), np.int64)) + (end - begin - (0 if out is None else out.sum(axis=1)))
            for sign, k in zip((1, -1), kept_ends(self.percentiles, of), strict=True):
                if k:
                    part = sign * similar[:, begin:end]
                    if out is not None:
                        part[out] = np.inf
                    self._add(key, sign, k, part)

    def _add(self, key: int | None, sign: int, k: int, part: np.ndarray) -> None:
        held = self.parts.setdefault((key, sign), [])
        held.append(part)
        n = sum(p.shape[1] for p in held)
        # cut when there are enough for the first time, and then whenever there are twice as many
        if n >= 2 * k or n >= k > n - part.shape[1]:
            every = np.concatenate(held, axis=1)
            every = np.partition(every, k - 1, axis=1)[:, :k] if n > k else every
            held[:] = [every]
            if key is not None and sign < 0:
                self.reached(key, every.max(axis=1))

    def results(self) -> Iterator[pa.RecordBatch]:
        for key, n in self.n.items():
            met = np.flatnonzero(n)
            n, ends = n[met], {}
            if self.total is None:
                n = np.full(len(met), self.of[key])  # of blocks that were passed over as well
            for sign in (1, -1):
                if held := self.parts.get((key, sign)):
                    ends[sign] = np.sort(np.concatenate(held, axis=1)[met], axis=1)
            out = np.empty((len(met), len(self.percentiles)))
            for c, p in enumerate(self.percentiles):
                place = p * (n - 1)
                at = np.floor(place).astype(np.int64)
                two = at, np.minimum(at + 1, n - 1)
                low, high = (ends[1][np.arange(len(met)), r] if p < 0.5 else -ends[-1][np.arange(len(met)), n - 1 - r] for r in two)
                out[:, c] = low + (high - low) * (place - at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[met], pa.int64()), pa.array([key] * len(met), pa.int64()), pa.array(n, pa.int64()), lists], ["face_id", "person_id", "n", "p"])


def filed(blocks: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """Blocks (block, rows, and of: all vectors of each of their persons) as a file each, and which; a row a block reaches the driver."""

    def flat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(1)[k].values
                columns = {"block": [batch.column(0)[k].as_py()], "person_id": [matrix(rows, "person_id")], "id": [matrix(rows, "id")], "of": [batch.column(2)[k].values], "vec": [np.ascontiguousarray(matrix(rows, "vec"), np.float64).tobytes()]}
                kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds, strict=True)], list(columns))

    table = written(blocks.select("block", "rows", "of").mapInArrow(flat, "block long, person_id array<bigint>, id array<bigint>, of array<bigint>, vec binary"), rows_a_file=1)
    return table, {r["block"]: r["file"] for r in table.select("block", F.col("_metadata.file_path").alias("file")).collect()}


def met(here: DataFrame, files: dict[int, str], asked_of: Callable[[pa.StructArray], Asked], faces_at_once: int, schema: str, room_for: int) -> tuple[DataFrame, int]:
    """What blocks of asked vectors (rows, and wanted: the known blocks that may matter; null: all) find, and how many pairs of
    blocks met. A task has some asked blocks and reads the files of the known ones, of which it keeps `room_for` numbers."""
    spark = here.sparkSession
    where, pairs = spark.sparkContext.broadcast(files), spark.sparkContext.accumulator(0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Known] = {}
        room = room_for
        for batch in batches:
            for k in range(batch.num_rows):
                rows, seen = batch.column(0)[k].values, set()
                wanted = batch.column(1)[k].values
                turns = [(0.0, b, None) for b in sorted(where.value)] if wanted is None else list(zip(*(wanted.field(c).to_pylist() for c in ("least", "b", "people")), strict=True))
                for begin in range(0, len(rows), faces_at_once):
                    asked = asked_of(rows.slice(begin, faces_at_once))
                    for least, b, people in turns:
                        if people is not None and not any(asked.needs(least, p) for p in people):
                            continue
                        if (known := held.get(b)) is None:
                            known = Known(where.value[b])
                            if known.vectors.size <= room:
                                held[b] = known
                                room -= known.vectors.size
                        of = None if people is None else {p for p in people if asked.needs(least, p)}
                        asked.meet(known, [g for g, p in enumerate(known.people) if of is None or p in of])
                        seen.add(b)
                    yield from asked.results()
                pairs.add(len(seen))

    n = here.count()
    tasks = max(1, min(n, max(-(-n // 4), 2 * spark.sparkContext.defaultParallelism)))
    found = written(here.select("rows", F.array_sort("wanted").alias("wanted")).repartition(tasks).mapInArrow(run, schema))
    return found, pairs.value


def searched(asked: DataFrame, known: Blocks, keep: int | Sequence[float], *, others_only: bool = False, within: float | None = None, only: DataFrame | None = None, best: bool = False) -> Found:
    """The nearest known vectors of each person for each asked one (id, vec and optionally rejected_ids: persons it must not meet).

    keep: how many; or, for the cosine, percentiles from 0.5 on, which the rows then hold (n and p) in place of the lists.
    `others_only`: a known vector of the same id is the asked one itself. What is asked for may be less than everything, and
    the lists are then whole as far only: `within` a distance; of the pairs of `only` (face_id, person_id) alone, each
    once; with `best`, of the face's nearest person.
    """
    cosine = known.cosine
    here = asked_blocks(asked, known.pivots, cosine)
    index = known.table.select(F.col("block").alias("b"), F.inline("owners"))
    people = index.groupBy("person_id").agg(F.sum("n").alias("of"))
    index = written(index.join(people, "person_id"))
    totals = index.groupBy(F.col("b").alias("block")).agg(F.sort_array(F.collect_list(F.struct("person_id", "of"))).alias("people"))
    table, files = filed(known.table.select("block", "rows").join(totals, "block").withColumn("of", F.col("people.of")))
    bounds = written(extents(here, known.table))
    pairs = bounds.join(index.select("b", "person_id"), "b")
    if within is not None:
        pairs = pairs.where(F.col("least") <= within * (1 + SLACK) + SLACK)
    if only is not None:
        faces = here.select(F.col("block").alias("a"), F.explode("rows.id").alias("face_id"))
        pairs = pairs.join(faces.join(only, "face_id").select("a", "person_id").distinct(), ["a", "person_id"], "left_semi")
    wanted = pairs.groupBy("a", "b").agg(F.first("least").alias("least"), F.first("most").alias("most"), F.collect_list("person_id").alias("people"))
    # nearest first, and of those that may touch the asked block the one whose vectors are surely near
    wanted = wanted.groupBy(F.col("a").alias("block")).agg(F.collect_list(F.struct("least", "most", "b", "people")).alias("wanted"))
    if isinstance(keep, int):
        asked_of, at_once, schema = lambda rows: Lists(rows, keep, cosine, others_only, best), FACE_BLOCK, f"face_id long, person_id long, of long, near {NEAR}"
    else:
        n, of_all = people.agg(F.count(F.lit(1)), F.sum("of")).first()
        ends = sum(kept_ends(keep, of_all)) + 2 * n
        asked_of, at_once, schema = lambda rows: Ends(rows, keep, dot), ends_at_once(ends), PERCENTILES
    rows, n_met = met(here.select("block", "rows").join(wanted, "block"), files, asked_of, at_once, schema, BROADCAST_NUMBERS)
    if only is not None:
        rows = rows.join(only.select("face_id", "person_id").distinct(), ["face_id", "person_id"], "left_semi")
    return Found(rows, n_met, bounds.count())


def dot(asked: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The cosine of vectors of length one."""
    return asked @ known.T


def ends_at_once(ends: int) -> int:
    """Of how many asked vectors a task keeps so many numbers at once, before they are cut."""
    return max(1, min(FACE_BLOCK, ENDS_NUMBERS // (2 * ends + GALLERY_BLOCK)))


def nearest_input(asked: DataFrame, *, cosine: bool = True) -> DataFrame:
    """Asked vectors as `searched` takes them."""
    more = ["rejected_ids"] if "rejected_ids" in asked.columns else []
    rows = prepared(asked, *more, cosine=cosine).withColumn("id", F.col("id").cast("long"))
    return rows.withColumn("rejected_ids", F.filter(F.coalesce("rejected_ids", F.array()).cast("array<bigint>"), lambda x: x.isNotNull())) if more else rows


def known_input(known: DataFrame, *, cosine: bool) -> DataFrame:
    """Known vectors as blocks take them."""
    return prepared(known, "person_id", cosine=cosine).where("person_id is not null").withColumns({"id": F.col("id").cast("long"), "person_id": F.col("person_id").cast("long")})


def known_blocks(known: DataFrame, *, cosine: bool) -> dict[int, Blocks]:
    """Known vectors (id, person_id, vec) in blocks, by their length: there are only a few lengths."""
    known = known_input(known, cosine=cosine)
    return {r["size"]: blocks_of(known.where(F.size("vec") == r["size"]), cosine) for r in known.groupBy(F.size("vec").alias("size")).count().collect()}


def nearest(asked: DataFrame, known: DataFrame, keep: int | Sequence[float], *, per_person: bool = True, cosine: bool = False, others_only: bool = False) -> Found:
    """`searched` over tables: asked (id, vec, optionally rejected_ids) against known (id, vec, and person_id if per person).

    Without persons every known vector counts as person 0's. Vectors of different lengths don't meet.
    """
    asked = nearest_input(asked if per_person else asked.select("id", "vec"), cosine=cosine)
    found = None
    for size, blocks in known_blocks(known if per_person else known.withColumn("person_id", F.lit(0)), cosine=cosine).items():
        part = searched(asked.where(F.size("vec") == size), blocks, keep, others_only=others_only)
        found = part if found is None else Found(found.rows.unionByName(part.rows), found.met + part.met, found.pairs + part.pairs)
    return found or Found(no_rows(known.sparkSession), 0, 0)


def no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"face_id long, person_id long, of long, near {NEAR}")
