"""Token counts and SentencePiece coding against the libraries themselves."""

import os

import pytest

from pictorium.llm import sentence_pieces as S
from pictorium.llm import token_counts as T
from tests.llm.helpers import documents, empty, messy

pytest.importorskip("public_tokenizers")
TEXTS = ["Hello  world\nfoo\n  bar ", "  a", " ", "\n\n", "a\tb\r\nc", "▁x  ▁ ▁▁y", "<s>hi</s> <0x0A> </s>", "é 　x y", "\x00a", "a​b", "don't WON'T we'll", "12345 1,000.50", "l'été İstanbul ΣΣ", "<|endoftext|>x <|startoftext|>", "a" * 300, "the " * 500, "!!!???...…", "你好世界 \U0001f600\U0001f44d", "x" + " " * 40 + "y", "ẛ̣ ﬁ"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.public_path(T.TOKENIZER))


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=T.public_path(S.MODEL))


def test_counts_are_the_librarys(spark, tokenizer):
    df = documents(spark, list(enumerate(TEXTS)))
    for entries in (0, 5, 1000):
        rows = T.token_counts(df, T.public_path(T.TOKENIZER), entries=entries).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {i: (len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}


def test_messy_counts(spark, tokenizer):
    rows = T.token_counts(messy(spark), T.public_path(T.TOKENIZER)).collect()
    want = sorted((r.doc_id or 0, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in messy(spark).collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == want
    assert T.token_counts(empty(spark), T.public_path(T.TOKENIZER)).collect() == []


def test_frequent_words_come_first(spark):
    df = documents(spark, [(1, "b b b a a c"), (2, "b a d " + "z" * 50)])
    assert T.frequent_words(df, 2) == ["b", "a"]


def test_pieces_are_the_librarys(spark, processor):
    texts = TEXTS + TEXTS[::2] + ["x" * 5000 + " y", "x" * 5000 + " z"]
    df = documents(spark, list(enumerate(texts)))
    for hot_bytes in (S.HOT_BYTES, 200, 0):
        rows = S.encode_decode(df, T.public_path(S.MODEL), hot_bytes=hot_bytes).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = [*processor.encode(texts[r.doc_id]), processor.eos_id()]
            assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, processor.decode(ids))


def test_no_chunk_is_segmented_twice(spark):
    import random

    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefg", k=rng.randrange(1, 9))) for _ in range(3000)] + ["z" * 900]
    texts = [" ".join(rng.choices(words, k=80)) + "\n" * (i % 3) for i in range(60)] + ["one  two"] * 3
    distinct = {c for t in texts for c in S.chunks(t)}
    df, model = documents(spark, list(enumerate(texts))), T.public_path(S.MODEL)
    table = S.chunk_table(df, model)
    shared = {r.chunk for r in table.collect()}
    assert table.count() == len(shared) and shared < distinct
    for hot_bytes in (S.HOT_BYTES, 3000, 0):
        rows = S.encode_decode(df, model, segmented=True, hot_bytes=hot_bytes).collect()
        assert len(shared) + sum(r.n_segmented for r in rows) == len(distinct)


def test_messy_pieces(spark, processor):
    rows = S.encode_decode(messy(spark), T.public_path(S.MODEL)).collect()
    want = sorted((r.doc_id or 0, [*processor.encode(r.text or ""), 2]) for r in messy(spark).collect())
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == want
    assert S.encode_decode(empty(spark), T.public_path(S.MODEL), digests=True).collect() == []


def test_whole_texts_where_chunks_dont_hold(processor):
    sp = S.Pieces(T.public_path(S.MODEL))
    assert sp.by_chunk
    sp.by_chunk = False
    for text in TEXTS:
        ids = [*processor.encode(text), 2]
        assert sp.encode(text, S.Hot())[:3] == (len(ids), " ".join(map(str, ids)), processor.decode(ids))


def test_a_worker_with_little_room(processor):
    """The texts of hot chunks are made anew when the cache starts afresh."""
    import pyarrow as pa

    sp, model = S.Pieces(T.public_path(S.MODEL)), T.public_path(S.MODEL)
    assert S.pieces(model).by_chunk
    known = sorted({c for t in TEXTS[::2] if t for c in S.chunks(t)})
    ids = sp.bare.encode(known)
    back = [b if b != c else None for b, c in zip(sp.bare.decode(ids), known, strict=True)]
    keys = pa.array([S.hashed(c) - 2**64 if S.hashed(c) >= 2**63 else S.hashed(c) for c in known], pa.int64())
    hot = S.Hot(pa.table({"key": keys, "ids": pa.array(ids, pa.list_(pa.int32())), "chunk": known, "back": pa.array(back, pa.string())}))
    hot.shown.limit = 1_500
    for text in TEXTS * 3:
        ids = [*processor.encode(text), 2]
        assert sp.encode(text, hot)[:3] == (len(ids), " ".join(map(str, ids)), processor.decode(ids))


def test_conditions_on_pieces():
    class Spec:
        precompiled_charsmap, remove_extra_whitespaces, add_dummy_prefix, escape_whitespaces = b"", False, True, True

    assert S.chunks_hold(["▁a", "b", "▁▁"], Spec)
    assert not S.chunks_hold(["a▁b"], Spec) and not S.chunks_hold(["a\n"], Spec)


def test_a_full_cache_starts_afresh():
    from pictorium.llm.common import BoundedCache

    cache = BoundedCache(5_000)
    for k in range(200):
        keys = {f"key{k}", f"key{k // 2}", "same"}
        cache.update(dict.fromkeys(cache.absent(keys), 1))
        assert keys <= cache.keys() and len(cache) < 40
    long = {"x" * 50_000}
    cache.update(dict.fromkeys(cache.absent(long), 1))
    cache.update(dict.fromkeys(cache.absent({"a"}), 1))
    assert set(cache) == {"a"}


def test_a_text_without_spaces(spark, tokenizer):
    """Five megabytes of one pre-token: counted as the library counts it, and not held on to."""
    text = "数据的处理" * 350_000
    (row,) = T.token_counts(documents(spark, [(1, text)]), T.public_path(T.TOKENIZER)).collect()
    assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False).ids))


def test_no_copies_of_tokenizer_files():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for d, _, fs in os.walk(root) if ".git" not in d for f in fs if f.endswith((".model", ".tiktoken"))]


def test_normal_pieces_are_not_decoded():
    """Chunks whose pieces are all normal are taken as what they decode to; the others are decoded, and both agree with the library."""
    import copy

    sp = copy.copy(S.pieces(T.public_path(S.MODEL)))
    chunks = sorted({c for t in [*TEXTS, "plain words, ok", "͸x é́ ⁇ ﻿"] for c in S.chunks(t)})
    want = [None if (back := sp.bare.decode(sp.bare.encode(c))) == c else back for c in chunks]
    asked = []

    class Bare:
        encode = sp.bare.encode

        def decode(self, ids, true=sp.bare.decode):
            asked.append(ids)
            return true(ids)

    sp.bare = Bare()
    assert [back for _, back in sp.segmented(chunks)] == want
    assert 0 < len(asked) < len(chunks) / 2
