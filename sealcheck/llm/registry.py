"""The queries of this subpackage, and their DuckDB statements where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from sealcheck.llm import (
    bytebpe, fill_middle, fingerprints, line_crf, line_dedup, ngram_join, packing, periodic_runs, pii, quality_rules, token_counts, toxicity, warc,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": line_crf.op2_quality_classifier,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_pii": pii.op6_pii,
    "op7_warc": warc.op7_warc,
    "op8_document_fingerprints": fingerprints.op8_document_fingerprints,
    "op9_byte_bpe": bytebpe.op9_byte_bpe,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op3_ngram_join": ngram_join.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
