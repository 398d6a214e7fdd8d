"""The pipeline on a small corpus, stage by stage against the operators."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from pictorium.llm import queries
from tests.llm.helpers import documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    rng = random.Random(9)
    vocabulary = ["the", "of", "and", "in"] * 40 + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(40, 120))
        texts.append((i, " ".join(words)))
        if i % 10 == 0:
            texts.append((1000 + i, " ".join(words)))
            texts.append((2000 + i, " ".join([*words[:-1], "ending"])))
    texts += [(3000, "too short"), (3001, None), (3002, "# " * 80), (None, "the of and in " + " ".join(rng.choices(vocabulary[160:], k=50))), (3003, "write to ann@mail.example.com of the " + " ".join(rng.choices(vocabulary[160:], k=50)))]
    df = documents(spark, texts, clash=False)
    df.write.parquet(f"{folder}/documents.parquet")
    return df


def test_stages(spark, tmp_path):
    df = corpus(spark, str(tmp_path))
    assert [n for n, _ in C.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "sentence pieces"]
    docs, kept = df, []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS and out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r.text for r in docs.collect()})
    after_rules, after_near, after_private, _ = kept
    assert not {3000, 3001, 3002} & set(after_rules) and {*range(60), None, 3003} <= set(after_rules)
    assert {*range(60), None, 3003} == set(after_near)
    assert set(after_private) == set(after_near) and "<EMAIL>" in after_private[3003] and "@" not in after_private[3003]
    assert {i: t for i, t in after_private.items() if i != 3003} == {i: t for i, t in after_near.items() if i != 3003}
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    last = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.decoded for r in last} == kept[-1]
    assert sorted((r.doc_id or -1, r.n_tokens) for r in C.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id or -1, r.n_tokens) for r in last)


def test_an_empty_table(spark, tmp_path):
    documents(spark, [], clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []


def test_odd_column_names(spark, tmp_path):
    """Every stage carries columns whose names hold dots, blanks and backticks."""
    df = corpus(spark, str(tmp_path)).withColumns({"my col": F.lit("x"), "a.b": F.lit(1), "c`d": F.lit(2)})
    docs = df
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    rows = docs.collect()
    assert rows and {(r["my col"], r["a.b"], r["c`d"]) for r in rows} == {("x", 1, 2)}
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
