"""Brute-force readings of the text rules, and a table with every odd case."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark green forest near a river "

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("row", T.StringType()), T.StructField("out", T.LongType()), T.StructField("n_words", T.LongType()),
                       T.StructField("score", T.DoubleType()), T.StructField("dropped", T.StringType()), T.StructField("n_chars", T.LongType())])

ODD_TEXTS = [None, "", " ", "\n\n", "one", "Ünïcode wörds hére\n\x00nul and\ttabs", PROSE * 3, PROSE * 3, PROSE.upper() * 3, PROSE * 2000,
             "a line that is shared by many\nown line of this one", "A Line That Is Shared By Many  \nanother\na line that is shared by many"]


def odd_documents(spark, texts=None):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names clash with inner ones."""
    rows = [(i, t, None if i % 2 else "en", "r", i, None, 0.5, None, len(t or "")) for i, t in enumerate(ODD_TEXTS if texts is None else texts)]
    rows.append((None, "a text without an id", None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())


def labels(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")
