"""Quality rules, mixing and archives against plain re-computations."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pictorium.llm import archives as A
from pictorium.llm import mixing as M
from pictorium.llm import quality_rules as Q
from tests.llm.helpers import documents, empty, messy


def counted(text):
    text = text or ""
    words, windows = re.findall(r"[^\x20\x09-\x0D]+", text), defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    texts = ["a b c d e", "a b c d e a b c d e f", "x x x x x x x", "a # b\n\na # b\n \n", "", None, "éé \U0001f600 |<>|", "one two three four five six seven eight nine ten", "p q r s t u p q r s t v " * 4, "a\x0bb\x0cc\r\nd e"]
    for df in (documents(spark, list(enumerate(texts))), messy(spark)):
        given_ = sorted(((r.doc_id or 0), counted(r.text)) for r in df.collect())
        rows = Q.quality_rules(df).collect()
        assert sorted(((r.doc_id or 0), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows) == given_
        for r in rows:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert Q.quality_rules(empty(spark)).collect() == []


def test_rules_run_without_user_functions(spark):
    plan = Q.quality_rules(documents(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_another_table(spark):
    texts = [(1, "of the " + " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"#w{i}" for i in range(60))), (3, " ".join(f"w{i}" for i in range(60)))]
    df = documents(spark, texts)
    assert {r.doc_id for r in Q.quality_rules(df).collect() if r.kept} == {1}
    assert {r.doc_id for r in Q.quality_rules(df, ()).collect() if r.kept} == {1, 2, 3}
    kept = Q.passing(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1}


def test_raking_meets_the_targets():
    rng = np.random.default_rng(1)
    cells = np.array([(s, g, t) for s in "abc" for g in "xy" for t in "pqr"], object).astype(str)
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.9, "y": 0.1}, {"p": 1.0, "q": 1.0, "r": 2.0}]
    w = M.raked(cells, tokens, targets)
    for d, share in enumerate(targets):
        for name, aim in share.items():
            assert abs(w[cells[:, d] == name].sum() / w.sum() - aim / sum(share.values())) < 1e-6
    assert M.raked(cells, tokens * 0, targets).sum() == 0


def test_a_category_without_documents_and_others():
    cells = np.array([("a", "x", "p"), (M.OTHER, "x", "p")], object).astype(str)
    w = M.raked(cells, np.array([10.0, 30.0]), [{"a": 0.5, "gone": 0.5}, {"x": 1.0}, {"p": 1.0}])
    assert np.allclose(w, [10.0, 30.0])


def test_contradicting_targets_are_told():
    cells = np.array([["a", "x", "p"], ["b", "y", "p"]], object)
    with pytest.warns(UserWarning, match="contradict"):
        w = M.raked(cells, np.array([10.0, 30.0]), [{"a": 0.9, "b": 0.1}, {"x": 0.2, "y": 0.8}, {"p": 1.0}])
    # the turns end with the later dimension's shares, and the sum stays
    assert np.allclose(w, [8.0, 32.0])


def test_mixing(spark):
    texts = [(i, ("word " * (5 + i % 7)) + ("| a | b |" if i % 4 == 0 else "")) for i in range(3000)]
    df = documents(spark, texts).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).withColumn("lang", F.when(F.col("doc_id") % 5 < 4, "en").otherwise("fr"))
    aims = {"source": {"s0": 0.5, "s1": 0.25, "s2": 0.25}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"prose": 0.7, "tables": 0.3}}
    rows = M.mixed(df, aims, 0.8).collect()
    assert len(rows) == 3000
    total = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens * r.probability for r in rows) / total - 0.8) < 1e-6
    for name, share in aims.items():
        sums = Counter()
        for r in rows:
            sums[r[name]] += r.n_tokens * r.probability * r.weight
        for k, aim in share.items():
            assert abs(sums[k] / sum(sums.values()) - aim) < 1e-6
    again = {r.doc_id: r.kept for r in M.mixed(df.repartition(7), aims, 0.8).collect()}
    assert again == {r.doc_id: r.kept for r in rows}
    assert M.sampled(df, aims, 0.8).columns == df.columns


def test_messy_mixing(spark):
    assert len(M.mixed(messy(spark)).collect()) == 10
    assert M.mixed(empty(spark)).collect() == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "first", "least", "value", "content")})


def test_pages_come_back(spark):
    rows = [(5, "http://a.example/x y", "<p>é</p>"), (3, "http://b.example/", "<p>é</p>"), (4, None, None), (2, "http://c.example/", ""), (9, "http://d.example/", "\r\n\r\nWARC/1.1\r\n\r\n" * 3), (10, "http://e.example/ü", "z" * 300_000), (None, "http://f.example/", "none")]
    folder = A.archived(pages(spark, rows))
    got = {r.page_id: r for r in A.read_back(spark, folder).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in rows:
        data = (h or "").encode()
        least = first.get(h or "")
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i is None or least == i else "revisit", None if i is None or least == i else least)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    shown = {r.page_id: r.record_type for r in A.read_back(spark, A.archived(pages(spark, rows), min_bytes=1)).collect()}
    assert shown[4] == shown[2] == "response" and shown[5] == "revisit"


def test_no_pages(spark):
    assert A.read_back(spark, A.archived(pages(spark, []))).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), max_size=6), st.sampled_from([1, 2]))
def test_arc_round_trip(blocks, version):
    data = A.write_arc("x.arc", [(f"http://h/{k}", b) for k, b in enumerate(blocks)], version)
    assert [(r.url, r.block) for r in A.read_arc(data)] == [(f"http://h/{k}", b) for k, b in enumerate(blocks)]


def test_conversion():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    for version in (1, 2):
        (record,) = A.read_arc(A.write_arc("x.arc", [("http://h/", block)], version))
        for refers, kind, kept in ((None, "response", block), ("<urn:uuid:1>", "revisit", block[:-4])):
            ((fields, back),) = A.read_warc(A.to_warc(record, A.record_id(1), refers) + b"\r\n\r\n")
            assert back == kept and fields["warc-type"] == kind and fields["warc-date"] == "2024-01-01T00:00:00Z"
            assert fields["warc-payload-digest"] == "sha1:" + A.sha1(b"body")
    (bad,) = A.read_arc(A.write_arc("x.arc", [("http://h/", block)])[:-3])
    assert bad.reason.startswith("cut off")
    with pytest.raises(ValueError):
        list(A.read_warc(A.to_warc(record, "x") + b"junk"))


HTTP = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"


def arc(lines, version=1):
    """An archive of (header line without its length, block)."""
    tail = b" 200 - - 0 x.arc" if version == 2 else b""
    data = A.write_arc("x.arc", [], version)
    return data + b"".join(line + tail + b" %d\n" % len(block) + block + b"\n" for line, block in lines)


def test_odd_header_lines():
    lines = [(b"http://h/a b c 1.2.3.4 20010203040506 text/html", HTTP + b"one"), (b"http://h/2 ::1 20010203040506 text/html; charset=utf-8", HTTP + b"two"), (b"dns:h 0.0.0.0 20010203 text/dns", b"h 1.2.3.4"), (b"http://h/\xff - 20010203040506 no-type", HTTP)]
    for version in (1, 2):
        got = list(A.read_arc(arc(lines, version)))
        assert [(r.url, r.address, r.date, r.kind) for r in got[:3]] == [("http://h/a b c", "1.2.3.4", "20010203040506", "text/html"), ("http://h/2", "::1", "20010203040506", "text/html; charset=utf-8"), ("dns:h", "0.0.0.0", "20010203", "text/dns")]
        assert [r.block for r in got] == [b for _, b in lines]
        # rubbish between records is set aside, and what follows it is read
        data = arc(lines[:2], version) + b"what is this\nand this 1\n" + arc(lines[2:], version)[len(A.write_arc("x.arc", [], version)) :]
        kinds = [type(r).__name__ for r in A.read_arc(data)]
        assert kinds == ["ArcRecord", "ArcRecord", "Unread", "ArcRecord", "ArcRecord"]
    assert [type(r).__name__ for r in A.read_arc(b"")] == ["Unread"] and [type(r).__name__ for r in A.read_arc(b"junk\nmore\n")] == ["Unread"]


def test_a_folder_of_archives(spark, tmp_path):
    import gzip

    lines = [(b"http://h/a b 1.2.3.4 20010203040506 text/html", HTTP + b"\xff\x00one"), (b"dns:h 0.0.0.0 20010203040506 text/dns", b"h 1.2.3.4")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.arc").write_bytes(arc(lines, 1))
    (tmp_path / "sub" / "b.arc.gz").write_bytes(b"".join(map(gzip.compress, (A.write_arc("x.arc", [], 2), arc(lines, 2)[len(A.write_arc("x.arc", [], 2)) :]))))
    (tmp_path / "c.arc").write_bytes(arc(lines, 1)[:-6])
    (tmp_path / "d.arc.gz").write_bytes(gzip.compress(arc(lines, 1))[:-20])
    (tmp_path / "e.txt").write_bytes(b"no archive")
    folder, bad = A.converted(spark, str(tmp_path))
    rows = A.read_back(spark, folder).collect()
    assert sorted((r.url, r.record_type, r.payload_bytes) for r in rows if r.url != "dns:h") [:2] == [("http://h/a b", "response", 5)] * 2
    assert {(r.record_type, r.payload_digest) for r in rows if r.url == "dns:h"} == {("resource", A.sha1(b"h 1.2.3.4"))}
    assert len({r.record_id for r in rows}) == len(rows) >= 5
    found = {(r.path.rsplit("/", 1)[-1], r.reason.split(":")[0]) for r in bad.collect()}
    assert {("c.arc", "cut off"), ("d.arc.gz", "gzip")} <= found
    again, _ = A.converted(spark, str(tmp_path))
    assert {r.record_id for r in A.read_back(spark, again).collect()} == {r.record_id for r in rows}


def test_files_are_bounded(spark):
    import glob

    folder = A.archived(pages(spark, [(i, f"http://h/{i}", f"{i} " * 300) for i in range(40)]).coalesce(1), file_bytes=3_000)
    assert len(glob.glob(f"{folder}/*.gz")) >= 10 and A.read_back(spark, folder).count() == 40


def test_every_source_has_a_target(spark):
    """260 sources, none lumped together, on the driver and as a table alike."""
    df = documents(spark, [(i, "word " * (1 + i % 50)) for i in range(2600)]).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 260).cast("string"))).withColumn("lang", F.lit("en"))
    aims = {"source": M.TEMPERED, "lang": {"en": 1.0}, "topic": {"prose": 1.0}}
    rows = M.mixed(df, aims, 0.8).collect()
    own, now = Counter(), Counter()
    for r in rows:
        own[r.source] += r.n_tokens
        now[r.source] += r.n_tokens * r.probability * r.weight
    goal = {s: n**M.TEMPER for s, n in own.items()}
    assert len(own) == 260 and all(abs(now[s] / sum(now.values()) - g / sum(goal.values())) < 1e-6 for s, g in goal.items())
    table = {r.doc_id: r for r in M.mixed(df, aims, 0.8, driver_cells=10).collect()}
    assert all(abs(table[r.doc_id].probability - r.probability) < 1e-4 and abs(table[r.doc_id].weight - r.weight) < 1e-3 for r in rows)


def test_the_querys_mixture_by_hand(spark):
    """Topics, tokens, raked factors and probabilities of the production targets, worked out plainly."""
    texts = [(i, text) for i, text in enumerate(["| a | b |\nthe rest", "all rights reserved by them", "ann@mail.example.com wrote", "in 1999 it was", "only prose here and more of it", None, ""] * 30)]
    df = documents(spark, texts, clash=False)
    rows = {r.doc_id: r for r in M.mixed(df).collect()}
    plain = lambda t: next((n for n, p in M.TOPICS.items() if re.search(p, t or "")), "prose")
    given_ = {r.doc_id: r for r in df.collect()}
    cells = defaultdict(float)
    known = {"lang": set(M.TARGETS["lang"]), "topic": set(M.TARGETS["topic"])}
    cell = lambda i: (given_[i].source or "null", given_[i].lang if given_[i].lang in known["lang"] else M.OTHER, plain(given_[i].text))
    for i, t in texts:
        assert (rows[i].topic, rows[i].n_tokens) == (plain(t), len((t or "").split()))
        cells[cell(i)] += len((t or "").split())
    w, total = {c: float(n) for c, n in cells.items()}, sum(cells.values())
    shares = []
    for d, name in enumerate(M.DIMENSIONS):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[d]] += n
        stated = {k: v**M.TEMPER for k, v in sums.items()} if name == "source" else {k: M.TARGETS[name][k] for k in sums if k in M.TARGETS[name] and sums[k]}
        rest = {k: v / total for k, v in sums.items() if k not in stated}
        shares.append({k: v * (1 - sum(rest.values())) / sum(stated.values()) for k, v in stated.items()} | rest)
    for _ in range(2000):
        for d, goal in enumerate(shares):
            sums = defaultdict(float)
            for c, n in w.items():
                sums[c[d]] += n
            w = {c: n * goal[c[d]] * sum(sums.values()) / sums[c[d]] if sums[c[d]] else 0.0 for c, n in w.items()}
    factor = {c: w[c] * total / sum(w.values()) / cells[c] if cells[c] else 0.0 for c in cells}
    low, high = 0.0, 1 / min(f for f in factor.values() if f > 0)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(cells[c] * min(1, middle * factor[c]) for c in cells) < M.KEEP * total else (low, middle)
    for i, _ in texts:
        chance = min(1, high * factor[cell(i)]) if cells[cell(i)] else 1.0
        assert abs(rows[i].probability - chance) < 1e-6 and abs(rows[i].weight - (factor[cell(i)] / chance if chance else 0.0)) < 1e-5


def test_counts_and_topics_of_the_caller(spark):
    df = documents(spark, [(i, "a b c") for i in range(40)], clash=False).withColumn("count", F.col("doc_id") + 1).withColumn("my topic", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"))
    rows = M.mixed(df, {"source": M.TEMPERED, "lang": M.TEMPERED, "topic": {"x": 0.5, "y": 0.5}}, tokens="count", topics="my topic").collect()
    assert all(r.n_tokens == r.doc_id + 1 and r.topic == "xy"[r.doc_id % 2] for r in rows)
