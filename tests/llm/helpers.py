"""Messy documents that every operator has to take."""

from pyspark.sql import functions as F

CLASHING = ("n_tokens", "n_bytes", "score", "set_id", "tokens", "key", "row", "rest", "spans", "base", "kept", "draw", "words", "windows", "size", "node", "label", "value", "doc")
LONG = "word " * 3000 + "x" * 20000 + " " + "7" * 5000 + "." * 3000 + "@" * 2000


def documents(spark, texts, *, clash=True):
    """(doc_id, text) pairs as documents, with further columns of names that operators use themselves."""
    rows = [(i, t, None if k % 5 == 4 else ("en", "fr")[k % 2], None if k % 7 == 6 else f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)}) if clash else df


def messy(spark):
    """Null and empty texts, a null id, repeated rows, a very long text, odd characters."""
    return documents(spark, [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (None, "no id here at all"), (5, "twice the same row of text"), (5, "twice the same row of text"), (6, LONG), (7, "\x00 ​ ▁ � \U0001f600 é İ <|endoftext|> <s> \r\n"), (8, "one"), (9, None)])


def empty(spark):
    return documents(spark, [])
