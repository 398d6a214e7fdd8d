"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model crosses from a character to a following white-space marker, and none holds a line feed, so a
text falls apart at those places: each chunk (its markers and what follows, or line feeds alone) has the same pieces
anywhere. `chunk_table` counts the chunks of all texts and segments each one that occurs more than once, a single time,
whatever its length; a chunk that occurs once is segmented where it stands. So no chunk is segmented twice. A text's
ids are then joined back by position: those of the most frequent chunks from a broadcast of at most HOT_BYTES (hashes
and ids in arrays, found by binary search), those of the other repeated chunks by a join of the text's own list of them.
Where the whole table is within the bound there is no join. `chunks_hold` proves the two conditions from a model's own
piece list; where they don't hold, whole texts are encoded.

The chunks go through the same model without its dummy prefix; the prefix is put before the whole text instead,
and decoding takes it off again, as the library's decode() does. Chunks are told apart by a 64-bit hash.

Null text counts as empty: it has the end id alone and decodes to the empty string. Null ids and repeated rows are
passed through row by row, other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.llm.common import BoundedCache, id_and_text, slices, tidy, written

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: The broadcast that every worker holds, text that a task counts before it hands on, and a worker's texts of ids.
HOT_BYTES = 96_000_000
COUNTED_BYTES = 24_000_000
CACHE_BYTES = 48_000_000
#: Beside its ids (four bytes each), an entry of the broadcast takes so many bytes.
ENTRY = 12
CHUNK = re.compile(r" *[^ \n]+| +|\n+")


class Pieces:
    """A model, loaded in a worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.by_chunk = chunks_hold([p.piece for p in model.pieces], model.normalizer_spec)
        # ids whose pieces may decode to something other than they stand for: unknown, bytes, controls and the like
        plain = not model.denormalizer_spec.precompiled_charsmap
        self.strange = frozenset(i for i, p in enumerate(model.pieces) if not plain or p.type != p.NORMAL)
        model.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end = self.whole.eos_id()

    def segmented(self, chunks: list[str]) -> Iterator[tuple[str, str | None]]:
        """Of each chunk its ids in decimals joined by spaces, and what they decode to where that isn't the chunk."""
        for chunk, ids in zip(chunks, self.bare.encode(chunks, num_threads=1), strict=True):
            yield " ".join(map(str, ids)), self.other(chunk, ids)

    def other(self, chunk: str, ids: list[int]) -> str | None:
        """What a chunk's ids decode to where that isn't the chunk. Normal pieces are parts of the chunk as it stands, and
        decode to it without being asked."""
        if self.strange.isdisjoint(ids):
            return None
        back = self.bare.decode(ids)
        return None if back == chunk else back

    def encode(self, text: str, table: Hot, own: tuple[list, list, list] | None = None) -> tuple[int, str, str, int]:
        """Number of ids, the ids in decimals joined by spaces (the end id is the last), the decoded text, and how many
        chunks neither the table nor the text's own list (chunks, ids, what they decode to) had."""
        if not self.by_chunk:
            ids = [*self.whole.encode(text, num_threads=1), self.end]
            return len(ids), " ".join(map(str, ids)), self.whole.decode(ids), 0
        if not text:
            return 1, str(self.end), "", 0
        parts = chunks(text)
        distinct = set(parts)
        missing, odd, more = table.looked_up(distinct), table.odd, {}
        if missing and own and own[0]:
            more = dict(zip(own[0], own[1], strict=True))
            odd = odd | {c: b for c, b in zip(own[0], own[2], strict=True) if b is not None}
            missing = [c for c in missing if c not in more]
        for chunk, (ids, back) in zip(missing, self.segmented(missing), strict=True):
            more[chunk] = ids
            if back is not None:
                odd = odd | {chunk: back}
        known = table.shown
        shown = f"{' '.join([known[c] if c in known else more[c] for c in parts] if more else [known[c] for c in parts])} {self.end}"
        shown_parts = parts if odd.keys().isdisjoint(distinct) else [odd.get(c, c) for c in parts]
        return shown.count(" ") + 1, shown, "".join(shown_parts)[1:], len(missing)


def hashed(chunk: str) -> int:
    return xxhash.xxh3_64_intdigest(chunk.encode())


class Hot:
    """Ids of the most frequent chunks: `keys` are their hashes, rising, `starts` where each one's ids begin in `ids`;
    `odd`: what the few decode to that don't give themselves back. Once in a worker, ids turn to text as they are used."""

    def __init__(self, rows: pa.Table | None = None):
        self.keys, self.starts, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.odd: dict[str, str] = {}
        if rows is not None and len(rows):
            keys, lists = rows.column("key").combine_chunks().to_numpy().view(np.uint64), rows.column("ids").combine_chunks()
            order = np.argsort(keys)
            size = np.diff(lists.offsets.to_numpy())[order]
            self.keys, self.starts = keys[order], np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(lists.offsets.to_numpy()[:-1][order] - self.starts[:-1], size) + np.arange(size.sum())
            self.ids = lists.values.to_numpy()[at].astype(np.int32)
            strange = rows.filter(rows.column("back").is_valid())
            self.odd = dict(zip(strange.column("chunk").to_pylist(), strange.column("back").to_pylist(), strict=True))
        self.shown = BoundedCache(CACHE_BYTES, 1.5)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "shown"}

    def __setstate__(self, state):
        self.__dict__ |= state | {"shown": BoundedCache(CACHE_BYTES, 1.5)}

    def without(self, distinct: Iterable[str]) -> list[str]:
        """The chunks that aren't among them."""
        distinct = list(distinct)
        return [c for c, k in zip(distinct, self._places(distinct).tolist(), strict=True) if k < 0]

    def _places(self, distinct: list[str]) -> np.ndarray:
        wanted = np.fromiter(map(hashed, distinct), np.uint64, len(distinct))
        at = np.searchsorted(self.keys, wanted)
        found = np.zeros(len(wanted), bool)
        within = at < len(self.keys)
        found[within] = self.keys[at[within]] == wanted[within]
        return np.where(found, at, -1)

    def looked_up(self, distinct: set[str]) -> list[str]:
        """Makes `shown` hold the ids of these chunks as text, and gives those that aren't among them."""
        new = [c for c in distinct if c not in self.shown]
        if not new:
            return []
        found = dict(zip(new, self._places(new).tolist(), strict=True))
        room = {c for c in new if found[c] >= 0} | (distinct - found.keys())
        wanted = self.shown.absent(room)
        # a full cache starts afresh, with chunks that it had shown before
        places = np.array([found[c] for c in wanted], np.int64) if found.keys() >= set(wanted) else self._places(wanted)
        for chunk, k in zip(wanted, places.tolist(), strict=True):
            self.shown[chunk] = " ".join(map(str, self.ids[self.starts[k] : self.starts[k + 1]].tolist()))
        return [c for c in new if found[c] < 0]


def chunks(text: str) -> list[str]:
    """The chunks of a text that isn't empty, in order, the prefix before the first."""
    return CHUNK.findall(" " + text.replace(MARK, " "))


def chunks_hold(pieces: list[str], spec) -> bool:
    """Whether no piece crosses into a marker or holds a line feed, and texts are taken as they are."""
    plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
    return plain and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each chunk occurs in a task's texts, in parts of bounded size."""
    schema = pa.schema([("chunk", pa.string()), ("n", pa.int64())])
    held: Counter = Counter()
    size = 0
    for part in slices(batches):
        for text in part["text"]:
            if text:
                held.update(chunks(text))
                size += len(text)
        if size > COUNTED_BYTES:
            yield pa.RecordBatch.from_pydict({"chunk": list(held), "n": list(held.values())}, schema)
            held.clear()
            size = 0
    yield pa.RecordBatch.from_pydict({"chunk": list(held), "n": list(held.values())}, schema)


def chunk_table(docs: DataFrame, model: str) -> DataFrame:
    """chunk, key (its hash), n, ids and back (null where the ids decode to the chunk): every chunk that occurs more
    than once."""

    def segment(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model)
        for part in slices(batches, size="chunk"):
            ids = sp.bare.encode(part["chunk"], num_threads=1)
            back = [sp.other(c, i) for c, i in zip(part["chunk"], ids, strict=True)]
            keys = np.fromiter(map(hashed, part["chunk"]), np.uint64, len(ids)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"chunk": part["chunk"], "key": keys, "n": part["n"], "ids": pa.array(ids, pa.list_(pa.int32())), "back": pa.array(back, pa.string())})

    counts = id_and_text(docs).select("text").mapInArrow(tidy(_counted), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return written(counts.where("n > 1").mapInArrow(tidy(segment), "chunk string, key long, n long, ids array<int>, back string"))


def _level() -> Column:
    return F.floor(4 * F.log2("n"))


def _hot_level(table: DataFrame, hot_bytes: int) -> tuple[int, bool]:
    """From which level of frequency on chunks are held by every worker, and whether others are left."""
    sizes = table.groupBy(_level().alias("level")).agg(F.sum(4 * F.size("ids") + F.lit(ENTRY)).alias("size")).collect()  # some 250 rows at most
    held, least = 0, 1 << 30
    for row in sorted(sizes, key=lambda r: -r["level"]):
        if held + row["size"] > hot_bytes:
            return least, True
        held, least = held + row["size"], row["level"]
    return least, False


def encode_decode(docs: DataFrame, model: str, *, digests: bool = False, segmented: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_tokens, and ids (array<int>) and decoded text; with `digests`, their SHA-256 in place of them; with
    `segmented`, how many chunks were segmented for the row beside those of the table."""
    given, hot, left = id_and_text(docs), Hot(), False
    if pieces(model).by_chunk:
        table = chunk_table(docs, model)
        least, left = _hot_level(table, hot_bytes)
        frequent = table.where(_level() >= least)
        # hot_bytes at most reach the driver; the chunks themselves only where they don't decode to themselves
        hot = Hot(frequent.select("key", "ids", F.when(F.col("back").isNotNull(), F.col("chunk")).alias("chunk"), "back").toArrow())
    held = docs.sparkSession.sparkContext.broadcast(hot)
    if left:
        # a text's own list of the other repeated chunks; texts that agree in the key share a list, which does no harm
        def unknown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                keys, found = [], []
                for key, text in zip(part["key"], part["text"], strict=True):
                    new = held.value.without(set(chunks(text))) if text else []
                    keys += [key] * len(new)
                    found += new
                yield pa.RecordBatch.from_pydict({"key": keys, "chunk": found}, pa.schema([("key", pa.int64()), ("chunk", pa.string())]))

        keyed = given.withColumn("key", F.xxhash64("text"))
        rare = table.where(_level() < least).select("chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), "back")
        wanted = keyed.select("key", "text").mapInArrow(tidy(unknown), "key long, chunk string").join(rare, "chunk")
        own = wanted.groupBy("key").agg(F.collect_set(F.struct("chunk", "ids", "back")).alias("own"))
        given = keyed.join(own.select("key", F.col("own.chunk").alias("own_chunk"), F.col("own.ids").alias("own_ids"), F.col("own.back").alias("own_back")), "key", "left").drop("key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known = pieces(model), held.value
        for part in slices(batches):
            lists = zip(part["own_chunk"], part["own_ids"], part["own_back"], strict=True) if "own_chunk" in part else [None] * len(part["text"])
            rows = [sp.encode(text, known, own) for text, own in zip(part["text"], lists, strict=True)]
            out = {"doc_id": pa.array(part["doc_id"], pa.int64()), "n_tokens": pa.array([r[0] for r in rows], pa.int64())}
            if digests:
                out |= {name: pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()) for k, name in ((1, "ids_sha256"), (2, "decoded_sha256"))}
            else:
                out |= {"ids": pa.array([np.fromstring(r[1], np.int32, sep=" ") for r in rows], pa.list_(pa.int32())), "decoded": pa.array([r[2] for r in rows], pa.string())}
            if segmented:
                out["n_segmented"] = pa.array([r[3] for r in rows], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    kept = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return given.mapInArrow(tidy(run), f"doc_id long, n_tokens long, {kept}" + ", n_segmented long" * segmented)
