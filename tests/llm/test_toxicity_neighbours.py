"""Held-out accuracy of toxicity scores, and recall and order of neighbours."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pictorium.llm import neighbours as N
from pictorium.llm import toxicity as X
from tests.llm.helpers import documents, empty, messy


def labelled(spark, n=700):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(600)]
    bad = ["zorblax", "vrungel", "quidzit"]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(15, 60))
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_and_misspelt(spark):
    docs, labels, truth = labelled(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = X.fitted(docs, labels, fold != 0)
    scores = {r.doc_id: r.score for r in X.scored(docs, model).collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.5) == bool(truth[i]) for i in held]) > 0.95
    new = documents(spark, [(1, "aaabb ccdd zorblaxx eeff vrungell gghh quidzitt iijj"), (2, "aaabb ccdd eeff gghh iijj kkll")])
    got = {r.doc_id: r.score for r in X.scored(new, model).collect()}
    assert got[1] > 0.5 > got[2]
    # scoring word by word is the model's own mean over the bag
    text = docs.where("doc_id = 6").first().text
    buckets, _ = X.features(X.words(text))
    assert abs(scores[6] - 1 / (1 + np.exp(-(model.share[buckets].mean() + model.bias)))) < 1e-9


def test_training_doesnt_see_the_held_out_or_the_order(spark):
    docs, labels, _ = labelled(spark, 150)
    allowed = F.col("doc_id") % 2 == 0
    one = X.fitted(docs, labels, allowed)
    other = X.fitted(docs.repartition(5), labels.withColumn("toxic", F.when(allowed, F.col("toxic")).otherwise(1 - F.col("toxic"))).repartition(3), allowed)
    assert np.array_equal(one.share, other.share) and one.bias == other.bias


def test_the_bag_of_a_long_text_is_whole():
    text = " ".join(f"word{k} word{k}" for k in range(6000)) + " onceonly"
    buckets, counts = X.bag(text)
    every = X.features(X.words(text))[0]
    assert len(buckets) > 8192 and set(buckets.tolist()) == set(every.tolist()) and counts.sum() == len(every)


def test_bags_within_their_bound(spark):
    docs, labels, truth = labelled(spark, 120)
    every, share = X.labelled_bags(docs, labels, F.lit(True), 1000, 10**9)
    few, same = X.labelled_bags(docs.union(docs.limit(50)), labels, F.lit(True), 1000, 100_000)
    size = lambda bags: sum(8 * len(b) for _, b, _ in bags)
    assert len(every) == 120 and 0 < len(few) < 120 and size(few) <= 100_000 < size(every) and share == same
    assert {y for y, _, _ in few} == {0, 1}


def test_messy_scores(spark):
    docs, labels, _ = labelled(spark, 100)
    model = X.fitted(docs, labels.union(labels.limit(3)).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")), F.lit(True))
    rows = X.scored(messy(spark), model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert X.scored(empty(spark), model).collect() == []
    none = X.fitted(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in X.scored(docs, none).collect()} == {0.5}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("vec", "rank", "score", "query_id")})


def brute(rows, asked, k):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in asked:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:k]
        out[q] = [(int(ids[b]), d[b]) for b in best if np.isfinite(d[b])]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(1500)]
    want = brute(rows, range(0, 1500, 100), 10)
    got = found(N.neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0))
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) / (10 * len(want)) >= 0.9
    exact = {q: dict(brute(rows, [q], 1500)[q]) for q in want}
    assert all(abs(exact[q][i] - s) < 1e-12 for q in got for i, s in got[q])


def test_ties_copies_and_unusable(spark):
    same, nan = [1.0, 0.0, 0.0], float("nan")
    rows = [(100, same), *[(i, same) for i in range(1, 31)], (200, [0.0, 1.0, 0.0]), (300, None), (301, []), (302, [0.0, 0.0, 0.0]), (400, [nan, 1.0, 1.0]), (401, [float("inf"), 1.0, 1.0]), (402, [None, 1.0, 1.0]), (403, [1.0, 2.0]), (None, same)]
    got = found(N.neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0))
    assert got[100] == [(i, 0.0) for i in range(1, 11)]
    assert set(got) == {100, 200} and len(got[200]) == 10


def test_fewer_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])]
    assert [i for i, _ in found(N.neighbours(vectors(spark, rows), F.col("vec_id") == 0))[0]] == [2, 1]
    assert N.neighbours(vectors(spark, rows[:1]), F.lit(True)).collect() == []
    assert N.neighbours(vectors(spark, []), F.lit(True)).collect() == []


def test_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 16, (500, 16)).astype(np.uint16)
    codes[200:260] = codes[7] ^ np.where(rng.random((60, 16)) < 0.3, 1 << rng.integers(0, 16, (60, 16)), 0).astype(np.uint16)
    index = N.Index(codes)
    for radius in (0, 3, 9, 14, 40, 100, 256):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[7]).sum(axis=1) <= radius)
        assert index.within(codes[7], radius).tolist() == want.tolist()


def test_few_rows_are_ranked(spark):
    """Of clustered vectors, and of random ones, which no index parts by probing, but codes do."""
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(40, 64))
    clustered = [(i, (middles[i % 40] + 0.3 * rng.normal(size=64)).tolist()) for i in range(4000)]
    random_ = [(i, rng.normal(size=64).tolist()) for i in range(4000)]
    for rows, most in ((clustered, 0.1), (random_, 0.3)):
        df = N.neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0)
        got, ranked = found(df), df.select("query_id", "n_ranked").distinct().collect()
        want = brute(rows, list(got), 10)
        recall = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (10 * len(want))
        share = sum(r.n_ranked for r in ranked) / (len(ranked) * len(rows))
        print("recall", recall, "share of rows ranked", share)
        assert recall >= 0.9 and share < most


def test_rounds_of_queries(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    N.QUERY_BYTES, kept = 7 * 64, N.QUERY_BYTES
    got = found(N.neighbours(vectors(spark, rows), F.col("vec_id") % 2 == 0, 5))
    N.QUERY_BYTES = kept
    assert set(got) == set(range(0, 60, 2))
