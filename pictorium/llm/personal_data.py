"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

First, e-mail addresses, IP addresses, payment cards and telephone numbers are found in every whole text. Each
distinct value is a protected entity. Then the corpus estimates how strongly each term reveals each entity: over all
documents, PMI(t; e) = log2(P(e | t) / P(e)), against what the entity itself is worth, IC(e) = log2(1 / P(e)). P(e) is
n(e) / N, and P(e | t) is smoothed, (n(t, e) + PRIOR P(e)) / (n(t) + PRIOR): a term counts as if PRIOR further documents
held it that know nothing of the entity, so few documents make a weak estimate and not none. A term whose PMI reaches
`disclosure` times IC(e) gives the entity away, be the entity in one text or in many, provided that both are positive
(an entity of all documents is worth nothing, so nothing reveals it) and that chance alone doesn't bring them together:
the term's occurrences in texts that hold the entity become spans of the kind `term`, outside the fixed spans. In
sanitised texts fixed spans are replaced by their kind and terms are generalised to TERM. Texts without an entity never
change.

Every text has rare words, and the longer it is the more of them, so a rare word next to an entity is no evidence by
itself. If terms fell on texts by chance, each occurrence would be in a text of the entity with the probability q, the
share of the corpus's characters that these texts hold. Of n texts with the term, x hold the entity too; that chance
gives so many has at most the probability exp(-n KL(x / n || q)) (Chernoff). Times the number of terms that are rare
enough to reveal anything, it is how many innocent terms an entity would lose: a term reveals only if that is at most
`chance`. x counts different texts, so copies of one text are one piece of evidence; math.inf asks for none.

Entities that stand in the same texts have the same counts with every term, and so have terms of the same texts with
the same total: each such class is estimated once. A list of thousands of addresses is one class of entities, the words
that only its text has are one class of terms, and no product of the two is ever made.

A term is a run of at least three letters, in lower case. Counts are over documents (rows). `support` asks that a term
stand with the entity in that many different texts; by default one is enough. Nothing is sampled or capped. Terms too
frequent to reveal anything are most of a text: the FREQUENT_TERMS most frequent of them are broadcast and go where they
stand, at every size alike; the others are joined with the counts.

Null text counts as empty and has no spans. Null ids and repeated rows are treated row by row, ties cannot arise (all
terms at the threshold count), other columns are ignored by `spans` and kept by `sanitised`, and an empty table gives
no rows. Positions are in code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from pictorium.llm.common import opened, slices, tidy, whole_row, written

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE, SUPPORT = 0.75, 1
PRIOR = 1.0
#: Innocent terms expected to be taken for revealing ones, for an entity.
CHANCE = 0.05
#: Frequent terms that every worker holds, the most frequent first, and terms that a task counts before it hands on.
FREQUENT_TERMS, COUNTED_TERMS = 50_000, 300_000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A match can only begin where a run of digits does, so the look-behind changes nothing but the cost of long runs.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign: as far left as the local part goes, then the longest domain. Linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield begin, end
            at = text.find("@", end)
        else:
            # what lies before a failed at sign can't be part of a later match, for @ is in no class
            end, at = at + 1, text.find("@", at + 1)


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = sum(int(d) for d in number[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all fixed patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(number := digits(m.group())) <= 19 and luhn(number):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def shown(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def read(spans: str) -> list[tuple[int, int, int]]:
    return [(int(a), KINDS.index(kind), int(b)) for kind, a, b in (s.split(":") for s in spans.split(",") if s)]


def entity(text: str, kind: int, start: int, end: int) -> str:
    value = text[start:end]
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else digits(value) if kind > 1 else value}"


def terms(text: str) -> set[str]:
    return {t.lower() for t in set(TERM.findall(text))}


def term_spans(text: str, revealing: set[str], fixed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Occurrences of revealing terms outside the fixed spans, which are sorted by their starts: both lists are walked once."""
    out, k, end = [], 0, 0
    for m in TERM.finditer(text):
        if m.group().lower() not in revealing:
            continue
        # `end`: how far the fixed spans reach that begin before the term does
        while k < len(fixed) and fixed[k][0] < m.end():
            end = max(end, fixed[k][2])
            k += 1
        if end <= m.start():
            out.append((m.start(), 4, m.end()))
    return out


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; what overlaps an earlier span is replaced with it."""
    parts, end = [], 0
    for start, kind, stop in spans:
        if start >= end:
            parts += [text[end:start], f"<{KINDS[kind].upper()}>"]
        end = max(end, stop)
    return "".join([*parts, text[end:]])


FOUND = "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, entities array<string>, text_key string, text string, n_chars long"


def _scanner(keep_all: bool, rest_type: pa.DataType | None):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), ("base", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("entities", pa.list_(pa.string())), ("text_key", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
        for batch in batches:
            done = 0
            for part in slices([batch.select(["doc_id", "text"])]):
                out: dict = {name: [] for name, _ in fields}
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    spans = fixed_spans(text)
                    per = Counter(kind for _, kind, _ in spans)
                    out["doc_id"].append(doc_id)
                    out["base"].append(shown(spans))
                    for k in range(4):
                        out[f"n_{KINDS[k]}"].append(per[k])
                    out["entities"].append(sorted({entity(text, k, a, b) for a, k, b in spans}))
                    out["text_key"].append(hashlib.blake2b(text.encode(), digest_size=16).hexdigest() if spans else None)
                    out["text"].append(text if spans or keep_all else None)
                    out["n_chars"].append(len(text))
                columns = [pa.array(out[name], kind) for name, kind in fields]
                n = len(part["doc_id"])
                names = [name for name, _ in fields]
                if rest_type is not None:
                    columns.append(batch.column(batch.schema.get_field_index("rest")).slice(done, n))
                    names.append("rest")
                done += n
                yield pa.RecordBatch.from_arrays(columns, names)

    return scan


def _seen_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents, and in how many different texts, each term occurs, of texts with their numbers of copies."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("n_texts", pa.int64())])
    held: Counter = Counter()
    texts: Counter = Counter()

    def counted() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"term": list(held), "n": list(held.values()), "n_texts": [texts[t] for t in held]}, schema)
        held.clear()
        texts.clear()
        return out

    for part in slices(batches):
        for text, copies in zip(part["text"], part["copies"], strict=True):
            for t in terms(text):
                held[t] += copies
                texts[t] += 1
        if len(held) > COUNTED_TERMS:
            yield counted()
    yield counted()


def _term_rows(frequent: Broadcast):
    """Each text with each of its terms but the frequent ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("text_key", pa.string()), ("n_chars", pa.int64()), ("term", pa.string())])
        for part in slices(batches):
            rows = [(k, n, t) for k, n, text in zip(part["text_key"], part["n_chars"], part["text"], strict=True) for t in terms(text) - frequent.value]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.types[k]) for k in range(3)], schema=schema)

    return run


def _term_counts(docs: DataFrame, wanted: DataFrame, frequent: Broadcast) -> DataFrame:
    """term, n_texts, n_t: in how many documents each wanted term (with its texts) occurs; none of them is frequent."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.string()), ("n", pa.int64())])
        held: Counter = Counter()
        for part in slices(batches):
            for text in part["text"]:
                held.update(terms(text) - frequent.value)
            if len(held) > COUNTED_TERMS:
                yield pa.RecordBatch.from_pydict({"term": list(held), "n": list(held.values())}, schema)
                held.clear()
        yield pa.RecordBatch.from_pydict({"term": list(held), "n": list(held.values())}, schema)

    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(count), "term string, n long")
    return counts.join(wanted, "term").groupBy("term", "n_texts").agg(F.sum("n").alias("n_t"))


def _by_chance(x: Column, n: Column, q: Column) -> Column:
    """The logarithm of a bound on the probability that of n occurrences x or more are where each is with probability q."""
    left, least = (n - x).cast("double"), F.lit(1e-300)
    apart = x * F.log(F.try_divide(x, n * q)) + left * (F.log(F.greatest(left, least)) - F.log(F.greatest(n * (1 - q), least)))
    return F.when((q >= 1) | (x <= n * q), F.lit(0.0)).otherwise(-apart)


def revealing_terms(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, chance: float = CHANCE) -> DataFrame | None:
    """text_key, text, base and the terms in that text that reveal one of its entities; None if there are none at all.

    As n(t, e) is n(e) at most, a term reveals an entity only if n(t) + PRIOR is at most n(e)^disclosure
    N^(1 - disclosure) (1 + PRIOR / N). That grows with n(e), so a text's most frequent entity bounds what its terms may
    count, and the frequent terms, which are most of a text, go before they meet entities. Chance has a bound of the same
    kind: q is at least a text's own share of all characters, and x at most the number of texts that hold entities and the
    term, so the words that only one long text has go as well. No pair above goes with them.
    """
    held = found.where("text_key is not null")
    texts = held.groupBy("text_key").agg(F.any_value("text").alias("text"), F.any_value("base").alias("base"), F.any_value("entities").alias("entities"), F.any_value("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    texts = written(texts)
    within = texts.select("text_key", "copies", (F.col("copies") * F.col("n_chars")).alias("chars"), F.explode("entities").alias("entity"))
    known = written(within.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.sum("chars").alias("chars_e"), *_same_texts()))
    most = known.agg(F.max("n_e")).first()[0]
    if most is None:
        return None
    whole = found.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("n_chars").cast("double").alias("chars")).first()
    total, chars = whole["n"], whole["chars"]
    bound = lambda n_e: F.pow(n_e, F.lit(disclosure)) * (total ** (1 - disclosure) * (1 + PRIOR / total) * (1 + 1e-9))
    seen = written(texts.select("text", "copies").mapInArrow(tidy(_seen_terms), "term string, n long, n_texts long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts")))
    # a term's count in the texts just read bounds its count in the corpus from below: what is frequent there goes
    possible = F.col("n") + PRIOR <= bound(F.lit(most))
    top = seen.where(~possible).orderBy(F.desc("n"), "term").limit(FREQUENT_TERMS).select("term")
    frequent = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in top.collect()))
    counted = written(_term_counts(docs, seen.where(possible).select("term", "n_texts"), frequent).where(F.col("n_t") + PRIOR <= bound(F.lit(most))))
    # logarithm of the number of terms that could be taken for revealing ones over the number that may be by chance
    tried = math.log(max(1, counted.count())) - math.log(chance) if chance < math.inf else -math.inf
    some = texts.select("text_key", "text", "n_chars").mapInArrow(tidy(_term_rows(frequent)), "text_key string, n_chars long, term string").join(counted, "term")
    rows = written(some.where(tried + F.col("n_texts") * F.log(F.col("n_chars") / chars) <= 1e-6).select("text_key", "term", "n_t"))
    terms_ = rows.groupBy("term", "n_t").agg(*_same_texts())
    of_term = written(terms_.select("term", F.xxhash64("n_t", "same_a", "same_b").alias("terms")))
    by_term = rows.join(of_term, "term").select("text_key", "terms", "n_t").distinct()
    of_entity = known.select("entity", "n_e", "chars_e", F.xxhash64("n_e", "same_a", "same_b").alias("entities"))
    by_entity = within.join(of_entity, "entity").select("text_key", "copies", "entities", "n_e", "chars_e").distinct()
    met = written(by_term.join(by_entity, "text_key").where(F.col("n_t") + PRIOR <= bound(F.col("n_e"))))
    share = F.col("n_e") / total
    given = (F.col("n_te") + PRIOR * share) / (F.col("n_t") + PRIOR)
    pairs = met.groupBy("entities", "terms", "n_e", "chars_e", "n_t").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    # copies are one piece of evidence; texts without the entity are counted as documents
    apart = _by_chance(F.col("texts"), F.col("texts") + F.col("n_t") - F.col("n_te"), F.col("chars_e") / chars)
    pairs = pairs.where(tried + apart <= 0)
    # an entity of all documents has no information to disclose, and a term that goes with it as with all others none either
    sure = written(pairs.where((F.col("n_e") < total) & (given > share) & (F.log2(given / share) >= -disclosure * F.log2(share))).select("entities", "terms"))
    if sure.isEmpty():
        return None
    revealing = met.join(sure, ["entities", "terms"]).select("text_key", "terms").distinct()
    marked = rows.join(of_term, "term").join(revealing, ["text_key", "terms"], "left_semi").groupBy("text_key").agg(F.collect_set("term").alias("terms"))
    return texts.select("text_key", "text", "base").join(marked, "text_key")


def _same_texts() -> list[Column]:
    """What tells a set of texts: two exclusive ors of hashes, whatever the order of the rows."""
    return [F.bit_xor(F.xxhash64("text_key", F.lit(k))).alias(f"same_{n}") for k, n in enumerate("ab")]


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("text_key", pa.string()), ("spans", pa.string())])
    for part in slices(batches):
        every = []
        for text, base, known in zip(part["text"], part["base"], part["terms"], strict=True):
            fixed = read(base)
            every.append(shown(sorted(fixed + term_spans(text, set(known), fixed))))
        yield pa.RecordBatch.from_pydict({"text_key": part["text_key"], "spans": every}, schema)


def _replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for part in slices([batch.select(["doc_id", "text", "spans"])]):
            n = len(part["doc_id"])
            texts = [replaced(t, read(s)) if s else t for t, s in zip(part["text"], part["spans"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(texts, pa.string()), batch.column(batch.schema.get_field_index("rest")).slice(done, n)], ["doc_id", "text", "rest"])
            done += n


def _scanned(docs: DataFrame, *, whole: bool) -> DataFrame:
    rest = [whole_row(docs, ("doc_id", "text")).alias("rest")] if whole else []
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *rest)
    schema = StructType.fromDDL(FOUND)
    return written(given.mapInArrow(tidy(_scanner(whole, pa.null() if whole else None)), schema.add(given.schema["rest"]) if whole else schema))


def _with_spans(docs: DataFrame, found: DataFrame, disclosure: float, support: int, chance: float) -> DataFrame:
    marked = revealing_terms(docs, found, disclosure, support, chance)
    if marked is None:
        return found.withColumn("spans", F.col("base"))
    extra = marked.mapInArrow(tidy(_mark), "text_key string, spans string")
    plain = found.where("text_key is null").withColumn("spans", F.col("base"))
    return plain.unionByName(found.where("text_key is not null").join(extra, "text_key", "left").withColumn("spans", F.coalesce("spans", "base")))


def spans(docs: DataFrame, *, disclosure: float = DISCLOSURE, support: int = SUPPORT, chance: float = CHANCE) -> DataFrame:
    """doc_id, counts of the four fixed kinds, `base` (their spans) and `spans` (all), as kind:start:end."""
    found = _scanned(docs, whole=False)
    return _with_spans(docs, found, disclosure, support, chance).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans")


def sanitised(docs: DataFrame, *, disclosure: float = DISCLOSURE, support: int = SUPPORT, chance: float = CHANCE) -> DataFrame:
    """The documents with all their columns, their texts sanitised (null stays empty text)."""
    found = _scanned(docs, whole=True)
    marked = _with_spans(docs, found, disclosure, support, chance)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    schema = StructType().add("doc_id", LongType()).add("text", StringType()).add(found.schema["rest"])
    out = marked.select("doc_id", "text", "spans", "rest").mapInArrow(tidy(_replace), schema)
    back = dict(zip(rest, opened(F.col("rest"), rest), strict=True))
    return out.select(*[F.col(c) if c in ("doc_id", "text") else back[c] for c in docs.columns])
