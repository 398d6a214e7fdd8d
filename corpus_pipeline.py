"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of `documents`. Rows with a null id pass the stages like any others (near duplicates keep them); a null text is
empty and fails the first stage; an empty table stays empty; further columns of `documents` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.llm import mixing, near_duplicates, personal_data, quality_rules, sentence_pieces, token_counts
from pictorium.llm.common import dropped, mark, table, written

#: On word shingles: five words, and this similarity in percent or more.
SIMILARITY_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.passing(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id."""
    return near_duplicates.deduplicated(docs, SIMILARITY_PERCENT)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars follows."""
    out = personal_data.sanitised(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target weights."""
    return mixing.sampled(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text."""
    return sentence_pieces.encode_decode(docs, token_counts.public_path(sentence_pieces.MODEL))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicate), ("personal data", private), ("mixing", mix), ("sentence pieces", pieces)]
#: Near duplicates, raking and pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        began = mark()
        docs = written(stage(spark, docs, sf_dir))
        # what the stage wrote on its way isn't read again
        dropped(spark, began, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
