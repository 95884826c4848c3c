"""The registered queries on the smallest tables, and the pipeline's stages one by one."""

import pytest

import corpus_pipeline
from checks import compare
from sealcheck.llm import common, registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_duckdb(spark, small_dir, name):
    ok, note, _ = compare.compare(spark, compare.connect(small_dir), small_dir, registry.QUERIES[name], registry.SQL[name])
    assert ok, note


def test_queries_are_whole():
    assert sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]) if n != "pipeline" else 99) == [
        "op1_quality_rules", "op2_quality_classifier", "op3_ngram_join", "op4_toxicity", "op5_line_dedup", "op6_pii", "op7_warc",
        "op8_document_fingerprints", "op9_byte_bpe", "op10_best_fit_packing", "op11_token_counts",
        "op12_periodic_runs", "op13_fill_in_middle", "pipeline"]


def test_stages(spark, small_dir):
    docs = common.table(spark, small_dir, "documents")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, small_dir), name)
        assert docs.columns == columns and docs.where("n_chars <> length(text)").count() == 0
        assert 0 < docs.count() <= rows
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir)
    assert packed.select("doc_id").distinct().count() == rows
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        nothing_left = stage(spark, nothing, small_dir)
        assert nothing_left.count() == 0
