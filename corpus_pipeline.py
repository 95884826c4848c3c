"""From raw documents to packed token sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it and reads it again as the next stage's
documents. All but the last return the columns of documents, with ``n_chars`` following the text. Null texts fail the first
stage's base rules. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealcheck.llm import common, line_dedup, ngram_join, packing, pii, quality_rules

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _with_text(found: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``row`` with another text and its length in code points."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules learned from the labels; rejected documents go."""
    with common.tidy_shuffles(spark):      # batches of a thousand whole texts; the caller writes with the session's own settings
        rules = quality_rules.fit(docs, common.table(spark, sf_dir, "labels"))
        return common.stage(quality_rules.keep_documents(docs, rules), "good")


def drop_seen_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go, and so do documents that are left with fewer words than the rules ask for."""
    found = line_dedup.with_clean_text(docs)
    words = F.size(F.filter(F.split("out.text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return _with_text(found.where((F.col("out.n_dropped") == 0) | (words >= quality_rules.LEAST_WORDS)), docs.columns, F.col("out.text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers and dates, mail addresses and secrets become pseudonyms."""
    return _with_text(pii.with_pseudonyms(docs, pii.DEMO_KEY), docs.columns, F.col("out.text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in the sequences."""
    return packing.packed_documents(docs, TOKENIZER)


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_seen_lines), ("ngram_join", drop_near_copies), ("pii", hide_personal_data),
          ("best_fit_packing", pack_sequences)]

#: The first stage applies rules that are learned from the labels, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
