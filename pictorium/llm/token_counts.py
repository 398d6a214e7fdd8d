"""Token counts: a two-tier lookup on the map side.

Tier one is a table of the most frequent pre-tokens and their lengths in tokens, which every worker gets once
(at most HOT_ENTRIES entries of at most HOT_BYTES bytes each). Tier two is the worker's own cache, bounded in bytes
(an unspaced text of megabytes is one pre-token); what neither knows is encoded by the tokenizer, once per worker. No pre-token is ever shuffled: finding the frequent
ones takes one pass in which each task keeps a bounded summary of its own words (lossy counting) and hands on
only its heaviest.

A pre-token here is a run of characters without space, tab, line feed or carriage return. The tokenizer drops
white space, its patterns never match across it and no canonical composition involves it, so the length of a text
in tokens is the sum over its pre-tokens; other kinds of space stay inside a pre-token, for the tokenizer to treat.
Strings of special tokens hold no space, so they too stay whole and are treated as the library's default does.

Null text counts as empty (0 bytes, 0 tokens). Null ids and repeated rows are passed through, row by row. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.llm.common import BoundedCache, id_and_text, slices

TOKENIZER = "word_bpe_49k.json"
HOT_ENTRIES = 32_768
HOT_BYTES = 32
#: A task's summary: it counts at most so many words at a time and hands on at most so many.
SUMMARY_COUNTED, SUMMARY_GIVEN = 100_000, 2_000
#: Memory of a worker's second tier.
CACHE_BYTES = 64_000_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _cache(path: str) -> BoundedCache:
    return BoundedCache(CACHE_BYTES)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; empty strings may stand between them."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def lengths(words: list[str], path: str) -> list[int]:
    """Tokens of each word by the library itself."""
    return [len(e.ids) for e in _tokenizer(path).encode_batch(words, add_special_tokens=False)]


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    floor = 0
    for part in slices(batches):
        for text in part["text"]:
            held.update(pre_tokens(text))
        # only short words can become frequent ones; the others would make the summary as large as the texts
        for word in [w for w in held if len(w) > HOT_BYTES]:
            del held[word]
        while len(held) > SUMMARY_COUNTED:
            floor += 1
            held = Counter({w: n for w, n in held.items() if n > floor})
    held.pop("", None)
    top = [(w, n) for w, n in held.most_common(SUMMARY_GIVEN) if len(w.encode()) <= HOT_BYTES]
    yield pa.RecordBatch.from_pydict({"word": [w for w, _ in top], "n": [n for _, n in top]}, pa.schema([("word", pa.string()), ("n", pa.int64())]))


def frequent_words(docs: DataFrame, entries: int = HOT_ENTRIES) -> list[str]:
    """The most frequent pre-tokens of all texts, at most `entries`: the only rows that reach the driver."""
    found = id_and_text(docs).select("text").mapInArrow(_summaries, "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries)
    return [r["word"] for r in top.select("word").collect()]


def token_counts(docs: DataFrame, tokenizer: str, *, entries: int = HOT_ENTRIES) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text. `tokenizer`: the file that each worker loads."""
    words = frequent_words(docs, entries)
    hot = docs.sparkSession.sparkContext.broadcast(dict(zip(words, lengths(words, tokenizer), strict=True)) if words else {})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = hot.value, _cache(tokenizer)
        for part in slices(batches):
            n_tokens = []
            for text in part["text"]:
                parts = pre_tokens(text)
                missing = second.absent({w for w in set(parts) if w not in first})
                second.update(zip(missing, lengths(missing, tokenizer), strict=True))
                n_tokens.append(sum([first[w] if w in first else second[w] for w in parts]))
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "n_bytes": part["n_bytes"], "n_tokens": n_tokens}, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())]))

    return id_and_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(count, SCHEMA)
