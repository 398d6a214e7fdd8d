"""Importance resampling towards a target: documents whose features the target holds more often are drawn more often.

Features are runs of one and two consecutive words, counted in buckets by CRC-32. For each bucket the target and the
corpus give a gain, the logarithm of the ratio of their smoothed shares; a document's weight is the mean gain of its
features. Adding a Gumbel number drawn from a hash of the id and taking the highest sums draws without replacement in
proportion to the exponentials of the weights.

CRC-32 is linear over exclusive or. The checksum of a message is the exclusive or of one contribution for each of its
bytes, which depends on the byte and on its distance from the message's end alone, and of a constant for the length. A
table of contributions by distance and byte is worked out once; a slice of texts is then one gather from it and one
`bitwise_xor.reduceat` over the spans of all features. A span longer than the table is cut into blocks of the table's
length, counted from its end: blocks are reduced alike and then folded in pairs, the further one advanced over the zeros
that stand for the nearer one, in as many rounds as the number of blocks has binary digits.

First pass: each task adds up its features in one array of buckets, so at most `buckets` rows leave a task, and `buckets`
sums reach the driver. Second pass: the gains are broadcast (8 bytes a bucket) and every text's features are summed. The
ranks come from `numbered`, which deals rows to ranges, so no task sorts them all.

A word is a run of ASCII letters or digits and of characters beyond ASCII; A-Z are lowered, nothing else is. Null text counts as
empty. A document without features weighs 0 and still has a score. A null id counts as empty text in its hash; repeated
rows are weighed row by row and rank next to each other; ties in the score go to the smaller id (null last). An empty
table gives no rows; an empty target gives each bucket the gain of its smoothing. Other columns are ignored by `weighted` and kept by
`resampled`. Very long texts are read in pieces of PIECE bytes (a longer word is one piece).
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.llm.common import id_and_text, slices, written
from pictorium.sources.shared import numbered

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Distances that the table holds, and bytes of spans and of text that are worked on at once.
DEPTH, GATHERED, PIECE = 64, 1 << 20, 1 << 20
_POLYNOMIAL = 0xEDB88320


@functools.cache
def _steps() -> np.ndarray:
    """What a checksum's low byte becomes when one zero byte follows: 256 numbers by rule."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(_POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


@functools.cache
def contributions() -> np.ndarray:
    """Contribution of each byte (column) at each distance from the end (row), in one flat table."""
    step, out = _steps(), np.empty((DEPTH, 256), np.uint32)
    out[0] = step
    for d in range(1, DEPTH):
        out[d] = step[out[d - 1] & 0xFF] ^ (out[d - 1] >> 8)
    return out.ravel()


@functools.cache
def _advance(power: int) -> np.ndarray:
    """The images of the 32 bits of a checksum when 2^power zero bytes follow, as four tables of bytes' images."""
    if power == 0:
        bits = [np.uint32(1 << b) for b in range(32)]
        images = np.array([_steps()[b & 0xFF] ^ (b >> 8) for b in bits], np.uint32)
    else:
        images = advanced(advanced(np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32)), power - 1), power - 1)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(np.arange(256) >> bit & 1, images[8 * byte + bit], 0).astype(np.uint32)
    return out


def advanced(sums: np.ndarray, power: int) -> np.ndarray:
    """Checksums (linear parts) after 2^power zero bytes more."""
    table = _advance(power)
    return table[0][sums & 0xFF] ^ table[1][sums >> 8 & 0xFF] ^ table[2][sums >> 16 & 0xFF] ^ table[3][sums >> 24]


@functools.cache
def _short_constants() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(4 * DEPTH)], np.uint32)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """The part of a checksum that depends on the length alone: the checksum of so many zeros."""
    short = _short_constants()
    if not len(lengths) or int(lengths.max()) < len(short):
        return short[lengths]
    different, back = np.unique(lengths, return_inverse=True)
    out = np.full(len(different), 0xFFFFFFFF, np.uint32)
    for power in range(int(different[-1]).bit_length()):
        out = np.where(different >> power & 1, advanced(out, power), out)
    return (out ^ np.uint32(0xFFFFFFFF))[back]


def checksums(held: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans (of one byte at least) of an array of bytes."""
    if not len(begins):
        return np.empty(0, np.uint32)
    table = contributions()
    counts = -(-lengths // DEPTH)
    whole = int(counts.max()) == 1
    if whole:
        at, sizes = begins, lengths
    else:
        # blocks of a span, from its end on; only the last one, at its beginning, is short
        nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        span = np.repeat(np.arange(len(begins)), counts)
        stop = begins[span] + lengths[span] - DEPTH * nth
        at = np.maximum(stop - DEPTH, begins[span])
        sizes = stop - at
    out = np.empty(len(at), np.uint32)
    upto = np.cumsum(sizes)
    done = 0
    while done < len(at):
        passed = int(upto[done - 1]) if done else 0
        stop = max(int(np.searchsorted(upto, passed + GATHERED, "right")), done + 1)
        n, starts = sizes[done:stop], upto[done:stop] - sizes[done:stop] - passed
        place = np.arange(int(n.sum()))
        # distance from the span's end, and the byte there
        distance = np.repeat(starts + n - 1, n) - place
        where = np.repeat(at[done:stop] - starts, n) + place
        out[done:stop] = np.bitwise_xor.reduceat(table[(distance << 8) | held[where]], starts)
        done = stop
    if not whole:
        power = DEPTH.bit_length() - 1
        while len(out) > len(begins):
            odd = nth % 2 == 1
            out[odd] = advanced(out[odd], power)
            firsts = np.flatnonzero(~odd)
            out = np.bitwise_xor.reduceat(out, firsts)
            nth = nth[firsts] // 2
            power += 1
    return out ^ length_constants(lengths)


@functools.cache
def _words() -> np.ndarray:
    """Each byte of a word as it counts, and a blank for all others."""
    known = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
    return np.array([b if b in known else b + 32 if b + 32 in known and chr(b).isupper() else 32 for b in range(256)], np.uint8)


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Some PIECE bytes of texts at a time: the words of one piece joined by blanks, each one's length and text, and
    whether the first word is the last one of the piece before, given again for the pair that it is part of."""
    joined = b"\0".join(texts)
    owner_ends = np.cumsum([len(t) + 1 for t in texts])
    raw, blank = np.frombuffer(joined, np.uint8), _words()
    begin, carried = 0, None
    while begin < len(raw):
        stop = begin + PIECE
        # up to the end of a word
        while stop < len(raw) and blank[raw[stop]] != 32:
            more = np.flatnonzero(blank[raw[stop : stop + PIECE]] == 32)
            stop = stop + int(more[0]) if len(more) else min(stop + PIECE, len(raw))
        part = blank[raw[begin : min(stop, len(raw))]]
        inside = part != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            owners = np.searchsorted(owner_ends, starts + begin, "right")
            lengths = ends - starts
            # one blank behind every word and nothing else between them
            follows = np.append(inside, False)
            follows[ends] = True
            held = np.append(part, np.uint8(32))[follows]
            if carried is not None:
                held, lengths, owners = np.concatenate([carried[0], held]), np.append(carried[1], lengths), np.append(carried[2], owners)
            yield held, lengths, owners, carried is not None
            n = int(lengths[-1])
            carried = held[-n - 1 :].copy(), lengths[-1:], owners[-1:]
        begin = stop


def features(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts, piece by piece: each feature's bucket and text, and the text of each word."""
    for held, lengths, owners, again in pieces(texts):
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        pair = np.flatnonzero(owners[1:] == owners[:-1])
        first = int(again)
        at = np.concatenate([begins[first:], begins[pair]])
        size = np.concatenate([lengths[first:], lengths[pair] + 1 + lengths[pair + 1]])
        yield checksums(held, at, size) % np.uint32(buckets), np.concatenate([owners[first:], owners[pair]]), owners[first:]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for part in slices(batches, as_bytes=True):
            for found, _, _ in features(part["text"], buckets):
                out += np.bincount(found, minlength=buckets)
        filled = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"bucket": filled, "n": out[filled]})

    sums = id_and_text(docs).select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # a row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the smoothed shares of each bucket, floored."""
    all_s, all_t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _gumbel(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighted(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document, against the texts of `target`."""
    held = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for part in slices(batches, as_bytes=True):
            n = len(part["text"])
            sums, n_features, n_words = (np.zeros(n, np.int64) for _ in range(3))
            for found, owners, of_words in features(part["text"], buckets):
                # sums of integers far below 2^53 are exact in doubles
                sums += np.bincount(owners, gain[found], n).astype(np.int64)
                n_features += np.bincount(owners, minlength=n)
                n_words += np.bincount(of_words, minlength=n)
            weight = np.where(n_features > 0, sums // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = id_and_text(docs).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", (F.col("weight") + _gumbel(F.col("doc_id"), seed)).cast("long"))


def ranked(scored: DataFrame, *, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of `weighted` with `rank`, from 1: of those with enough words, `share` per cent by falling score; null for the others."""
    scored = written(scored)
    fit = F.col("n_words") >= least_words
    quota = scored.where(fit).count() * share // 100
    placed = numbered(scored, [F.desc("score"), F.col("doc_id").asc_nulls_last()], counts=fit, name="place")
    return placed.withColumn("rank", F.when(fit & (F.col("place") <= quota), F.col("place"))).drop("place")


def resampled(docs: DataFrame, target: DataFrame, *, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The documents that are drawn, with all their columns. Rows that share an id are drawn by their best row."""
    drawn = ranked(weighted(docs, target, buckets=buckets, seed=seed), share=share, least_words=least_words).where("rank is not null")
    ids = drawn.select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_drawn"]), "left_semi")
