"""Personal data against plain patterns, and the estimate of what terms reveal against a count by hand."""

import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pictorium.llm import personal_data as P
from tests.llm.helpers import documents, empty, messy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    number = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(number(m)) <= 19 and luhn(number(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(number(m)) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-+_%0123459 ()\né", max_size=60))
def test_spans_are_the_patterns(text):
    assert P.fixed_spans(text) == plain(text)


def test_known_cases():
    for text in ("a@b.c@d.e", "a@@b.c", "x a@b", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5", "256.1.1.1", "0001.2.3.4", "+1 (017) 555-7713 x", "+1 ()", "a@b.c.d..e", "@a.b", "1.1.1", "+12345678901234567890"):
        assert P.fixed_spans(text) == plain(text), text


def test_long_runs_stay_linear():
    import time

    began = time.time()
    for unit in ("1", "a", "a@", "1.", "+", "1 ", "-", "+1"):
        P.fixed_spans(unit * (200_000 // len(unit)))
    assert time.time() - began < 20


def revealing(texts, disclosure, support, chance=P.CHANCE):
    spans = {i: plain(t) for i, t in texts}
    holds = {i: {P.entity(t, k, a, b) for a, k, b in spans[i]} for i, t in texts}
    terms = {i: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)} for i, t in texts}
    n = len(texts)
    chars = sum(len(t) for _, t in texts)
    in_docs = {t: sum(t in terms[i] for i, _ in texts) for t in set().union(*[terms[i] for i, _ in texts if holds[i]])}
    most = max(sum(e in holds[i] for i, _ in texts) for e in set().union(*holds.values()))
    tried = sum(k + 1 <= most**disclosure * n ** (1 - disclosure) * (1 + 1 / n) for k in in_docs.values())

    def innocent(x, k, q):
        """How many terms chance would bring together so: an upper bound of a binomial tail."""
        if q >= 1 or x <= k * q:
            return float(tried)
        apart = x * math.log(x / (k * q)) + ((k - x) * math.log((k - x) / (k * (1 - q))) if k > x else 0)
        return tried * math.exp(-apart)

    out = {}
    for e in set().union(*holds.values()):
        with_e = [i for i, _ in texts if e in holds[i]]
        for t in set().union(*[terms[i] for i in with_e]):
            both = [i for i in with_e if t in terms[i]]
            n_t = sum(t in terms[i] for i, _ in texts)
            share = len(with_e) / n
            given_ = (len(both) + share) / (n_t + 1)
            x = len({dict(texts)[i] for i in both})
            if chance < math.inf and innocent(x, x + n_t - len(both), sum(len(dict(texts)[i]) for i in with_e) / chars) > chance:
                continue
            if len(with_e) < n and given_ > share and len({dict(texts)[i] for i in both}) >= support and math.log2(given_ / share) >= -disclosure * math.log2(share):
                for i in both:
                    out.setdefault(i, set()).add(t)
    return out


def test_revealing_terms(spark):
    rng = random.Random(6)
    common = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = []
    for i in range(120):
        words = rng.choices(common, k=12)
        if i % 10 == 0:
            words += ["Zanzibar", "ann@mail.example.com"] + (["harbour"] if i % 20 == 0 else [])
        if i % 15 == 3:
            words += ["+1 (407) 555-7710"]
        rng.shuffle(words)
        texts.append((i, " ".join(words)))
    texts += [(500 + k, texts[0][1]) for k in range(5)]
    for few, chance in ((P.FREQUENT_TERMS, math.inf), (1, math.inf), (P.FREQUENT_TERMS, P.CHANCE), (1, P.CHANCE), (1, 1e-6)):
        P.FREQUENT_TERMS, kept = few, P.FREQUENT_TERMS
        rows = {r.doc_id: r for r in P.spans(documents(spark, texts), chance=chance).collect()}
        P.FREQUENT_TERMS = kept
        want = revealing(texts, P.DISCLOSURE, P.SUPPORT, chance)
        assert want
        for i, t in texts:
            got = [t[a:b].lower() for a, k, b in P.read(rows[i].spans) if k == 4]
            # the parts of the address reveal it too, but stand within its own span
            outside = {m.group().lower() for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < b for a, _, b in plain(t))}
            assert sorted(set(got)) == sorted(want.get(i, set()) & outside)
            assert [s for s in P.read(rows[i].spans) if s[1] != 4] == plain(t) == P.read(rows[i].base)


def test_an_entity_of_one_text_is_estimated(spark):
    common = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = [(i, " ".join(random.Random(i).choices(common, k=12))) for i in range(300)]
    texts += [(900, "alpha Zanzibar beta ann@mail.example.com gamma"), (901, "delta Zanzibar +1 (407) 555-7710 harbour"), (902, "alpha harbour beta"), (903, "gamma harbour"), (904, "zeta harbour")]
    total, spans = len(texts), {}
    for few in (P.FREQUENT_TERMS, 1):
        P.FREQUENT_TERMS, kept = few, P.FREQUENT_TERMS
        rows = P.spans(documents(spark, texts), chance=math.inf).collect()
        P.FREQUENT_TERMS = kept
        spans = {r.doc_id: [dict(texts)[r.doc_id][a:b] for a, k, b in P.read(r.spans) if k == 4] for r in rows}
        # smoothed by one document: Zanzibar stands in 2 documents, harbour in 4
        reveals = lambda n_t: math.log2((1 + 1 / total) / (n_t + 1) * total) >= P.DISCLOSURE * math.log2(total)
        assert reveals(2) and not reveals(4)
        assert spans.pop(900) == ["Zanzibar"] and spans.pop(901) == ["Zanzibar"]
        assert not any(spans.values())


def test_sanitised(spark):
    texts = [(1, "mail ann@mail.example.com or 10.0.0.1 now"), (2, "nothing here"), (3, None)]
    df = documents(spark, texts)
    rows = P.sanitised(df)
    assert rows.columns == df.columns
    assert {r.doc_id: r.text for r in rows.collect()} == {1: "mail <EMAIL> or <IP> now", 2: "nothing here", 3: ""}


def test_messy(spark):
    rows = P.spans(messy(spark)).collect()
    assert len(rows) == 10 and {r.doc_id for r in rows if r.spans} <= {6}
    assert P.sanitised(messy(spark)).count() == 10
    assert P.spans(empty(spark)).collect() == [] and P.sanitised(empty(spark)).collect() == []


def test_an_entity_of_all_texts_reveals_nothing(spark):
    texts = [(i, f"alpha beta word{'abcdef'[i]} ann@mail.example.com gamma") for i in range(6)]
    assert all("term" not in r.spans for r in P.spans(documents(spark, texts)).collect())


def test_term_spans_against_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["abc", "xyz", " ", "1", "-", "longer"]) for _ in range(30))
        fixed = sorted((a := rng.randrange(len(text)), 0, a + rng.randrange(1, 9)) for _ in range(rng.randrange(5)))
        want = [(m.start(), 4, m.end()) for m in P.TERM.finditer(text) if m.group() in ("abc", "longer") and not any(a < m.end() and m.start() < b for a, _, b in fixed)]
        assert P.term_spans(text, {"abc", "longer"}, fixed) == want


def test_a_text_of_many_entities(spark):
    """3,000 addresses and 8,000 terms in one text of 100 kB are one class each: their product is never made."""
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    long = " ".join([f"{letters(i)}@host{i % 7}.example.com" for i in range(3000)] + [f"zz{letters(i)}" for i in range(8000)])
    texts = [(1, long), (2, long + " more"), (3, "zzaaaa alone")] + [(i, "plain words here") for i in range(10, 400)]
    rows = {r.doc_id: r for r in P.spans(documents(spark, texts, clash=False), chance=math.inf).collect()}
    assert rows[1].n_email == 3000 and rows[1].spans.count("term:") == 8000 and rows[3].spans == ""


def test_odd_column_names(spark):
    df = documents(spark, [(1, "mail ann@mail.example.com now"), (2, "none")], clash=False).withColumns({"my col": F.lit("x"), "a.b": F.lit(1), "c`d": F.lit(2)})
    out = P.sanitised(df)
    assert out.columns == df.columns and {(r["my col"], r["a.b"], r["c`d"]) for r in out.collect()} == {("x", 1, 2)}


def test_planted_terms_are_told_from_rare_words(spark):
    """A name that goes with an address reveals it; the rare words that every text has of its own don't."""
    rng = random.Random(11)
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = []
    for i in range(400):
        words = [f"common{letters(rng.randrange(40))}" for _ in range(30)] + [f"rare{letters(rng.randrange(1500))}" for _ in range(5)] + [f"own{letters(i)}x{letters(i + k)}" for k in range(3)]
        if i % 40 < 3:
            # ten persons in three texts each
            words += [f"Person{letters(i // 40)}", f"p{i // 40}@mail.example.com"]
        elif i % 7 == 0:
            words.append(f"solo{i}@mail.example.com")
        rng.shuffle(words)
        texts.append((i, " ".join(words)))
    rows = {r.doc_id: r for r in P.spans(documents(spark, texts)).collect()}
    found = {i: {t[a:b] for a, k, b in P.read(rows[i].spans) if k == 4} for i, t in texts}
    assert found == {i: {f"Person{letters(i // 40)}"} if i % 40 < 3 else set() for i, _ in texts}
    # without a regard to chance hundreds of innocent words go
    loose = P.spans(documents(spark, texts), chance=math.inf).collect()
    assert sum(r.spans.count("term:") for r in loose) > 300


def test_copies_are_one_piece_of_evidence(spark):
    words = "harbour zenith quartz mail ann@mail.example.com"
    texts = [(i, words) for i in range(20)] + [(100 + i, f"alpha beta gamma delta word{'abcdefghij'[i % 10]}") for i in range(400)]
    assert all("term" not in r.spans for r in P.spans(documents(spark, texts)).collect())
    assert any("term" in r.spans for r in P.spans(documents(spark, texts), chance=math.inf).collect())


def test_the_bound_of_chance_is_above_the_tail(spark):
    cases = [(x, n, q) for n in (1, 2, 3, 10, 40) for x in range(1, n + 1) for q in (1e-6, 0.01, 0.3, 0.9, 1.0)]
    df = spark.createDataFrame(cases, "x long, n long, q double")
    for r in df.withColumn("log", P._by_chance(F.col("x"), F.col("n"), F.col("q"))).collect():
        tail = sum(math.comb(r.n, k) * r.q**k * (1 - r.q) ** (r.n - k) for k in range(r.x, r.n + 1))
        assert math.exp(r.log) >= tail * (1 - 1e-9) and r.log <= 0
        assert r.x < r.n or r.q == 1 or math.isclose(r.log, r.n * math.log(r.q), rel_tol=1e-9)
