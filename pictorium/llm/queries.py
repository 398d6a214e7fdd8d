"""The corpus operators' queries over the driver tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.llm import quality_rules as quality
from pictorium.llm import archives, fill_in_middle, mixing, neighbours, personal_data, repeated_passages, resampling, secret_scans, toxicity
from pictorium.llm import near_duplicates as near
from pictorium.llm import sentence_pieces, token_counts
from pictorium.llm.common import table
from pictorium.llm.oracles import ORACLE_SQL as ORACLE_SQL

MAX_TOKENS = 2048


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.public_path(token_counts.TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), fold != 0)
    held_out = F.coalesce(fold == 0, F.lit(False))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = token_counts.public_path(sentence_pieces.MODEL)
    return sentence_pieces.encode_decode(table(spark, sf_dir, "documents"), model, digests=True)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archives.archived(table(spark, sf_dir, "pages"))
    return archives.read_back(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = secret_scans.shown(F.filter("spans", lambda s: s["kind"].isin(*secret_scans.BASE)))
    return found.select("doc_id", *map(of_kind, secret_scans.BASE), F.sha2(base, 256).alias("base_sha256"), secret_scans.shown(F.col("spans")).alias("spans"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resampling.weighted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    return resampling.ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.restored(fill_in_middle.filled_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_neighbours": op4_neighbours,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_secret_scans": op11_secret_scans,
    "op12_resampling": op12_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
}
