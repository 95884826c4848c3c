"""Every stage on odd rows, and what line dedup leaves of copies."""

import random
import re

from helpers import ODD_TEXTS, odd_documents

import corpus_pipeline
from sealcheck.llm import line_dedup, quality_rules


def test_every_stage_takes_odd_rows(spark, small_dir):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, small_dir)
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert len(rows) <= len(ODD_TEXTS) + 1 and all(r["n_chars"] == len(r["text"] or "") for r in rows if r["n_chars"] is not None), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {*range(len(ODD_TEXTS)), None}


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(3, 8))) for _ in range(n))


def test_remnants_of_copies_go(spark, small_dir):
    first, second, own = prose(1, 80), prose(2, 80), prose(3, 70)
    texts = {1: f"{first}\n{second}", 2: f"{first}\n{second}", 3: f"{first}\n{own}", 4: f"{second}\nten words left", 5: "short but nobody's copy", 6: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r for r in corpus_pipeline.drop_seen_lines(spark, docs, small_dir).collect()}
    assert {i: r["text"] for i, r in kept.items()} == {1: texts[1], 3: own, 5: texts[5], 6: ""}
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    whole = {r["row"]["doc_id"]: r["out"]["text"] for r in line_dedup.with_clean_text(docs).collect()}
    assert whole[2] == "" and whole[4] == "ten words left"        # the operator itself drops lines only


def test_a_kept_text_crosses_to_python_once(spark):
    docs = odd_documents(spark)
    counted = quality_rules.with_counts(docs)
    plan = counted._jdf.queryExecution().analyzed().toString()
    assert re.search(r"MapInArrow run\(row#\d+, text#\d+\).*\[row#\d+, text#\d+, out#\d+\]", plan), plan
    assert counted.columns == ["row", "out"] and counted.select("row.*").columns == docs.columns
    assert sorted(map(str, counted.select("row.*").collect())) == sorted(map(str, docs.collect()))
