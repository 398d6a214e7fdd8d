"""Near-duplicate components against all pairs."""

import random

import numpy as np
import pytest

from pictorium.llm import near_duplicates as N
from pictorium.llm import shingles
from pictorium.llm.components import components
from tests.llm.helpers import documents, empty, messy


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(texts, percent=85):
    ids = [i for i, t in texts if i is not None and sets_of(t)]
    sets = {i: sets_of(t) for i, t in texts}
    root = {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in texts}


def corpus(seed=3, n_base=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, key = [], 0
    for _ in range(n_base):
        base = rng.choices(vocabulary, k=rng.randrange(40, 160))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append((key, rng.choice([" ", "\n", "\t"]).join(words).title()))
            key += 1
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("node_sets", [1000, 4])
def test_components(spark, node_sets):
    texts = corpus()
    rows = N.near_duplicates(documents(spark, texts), node_sets=node_sets).collect()
    want = brute(texts)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(sets_of(t)) for i, t in texts}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_messy(spark):
    rows = N.near_duplicates(messy(spark)).collect()
    assert len(rows) == 10
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in rows}
    assert got[1] == (1, 0, True) and got[2] == (2, 0, True) and got[3] == (3, 0, True) and got[9] == (9, 0, True)
    assert got[None] == (None, 1, True)
    assert [r.component_id for r in rows if r.doc_id == 5] == [5, 5] and got[8] == (8, 1, True)
    assert N.near_duplicates(empty(spark)).collect() == []


def test_copies_are_one(spark):
    texts = [(i, "The same short text here again") for i in range(40)] + [(100, "the SAME short\ttext here again"), (101, "another one")]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(documents(spark, texts)).collect()}
    assert got == {**{i: 0 for i in range(40)}, 100: 0, 101: 101}
    left = N.deduplicated(documents(spark, texts))
    assert {r.doc_id for r in left.collect()} == {0, 101} and left.columns == documents(spark, texts).columns


def test_node_links_are_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) > rng.choice([0, 0.05, 0.1, 0.2])], rng.integers(0, 2**60, rng.integers(0, 20), dtype=np.uint64)])) for _ in range(60)]
    group = list(range(60))
    for i, j in N.node_links(sets, 80):
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    want = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = want[i], want[j]
                want = [min(a, b) if g in (a, b) else g for g in want]
    assert group == want


def test_shingles_follow_the_words():
    assert len(shingles.shingle_set(b"a b c d e f")) == 2 and len(shingles.shingle_set(b"A b\x0bc")) == 1 and len(shingles.shingle_set(b" \n")) == 0
    assert shingles.shingle_set(b"A B C") == shingles.shingle_set(b"a\tb\rc")
    assert shingles.shingle_set("É x".encode()) != shingles.shingle_set("é x".encode())


def test_components_of_a_graph(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
