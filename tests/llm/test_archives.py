"""WARC archives read back, and fingerprints against exact sets."""

import hashlib

import numpy as np
from helpers import ODD_TEXTS, PROSE, empty_documents, odd_documents, shingles

from sealcheck.llm import common, fingerprints, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, row string")


def test_archives_hold_every_page(spark):
    big = "<p>" + PROSE * 20 + "é</p>"
    rows = [(3, "http://a/ü x?\r\ny", big, None), (1, None, big, "x"), (2, "http://b", None, None), (4, "http://c", "", None), (5, "u", "short", None),
            (6, "u", "short", None), (7, "u", big + "\r\n\r\nWARC/1.1", None), (None, "u", big, None)]
    folder = common.shared_path(spark, "warctest")
    index = warc.write_archives(pages(spark, rows), folder)
    found = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    assert len(found) == len(rows) and found["3"]["record_type"] == "revisit" and found["3"]["refers_to"] == "1" and found["3"]["payload"] is None
    for page_id, _, html, _ in rows:
        record, payload = found[None if page_id is None else str(page_id)], (html or "").encode()
        assert record["payload_bytes"] == len(payload) and record["digest"] == hashlib.sha256(payload).hexdigest()
        assert page_id == 3 or bytes(record["payload"]) == payload and record["record_type"] == "response"
    some = warc.read_records(index.where("page_id IN ('2', '7')"), folder).collect()
    assert {r["page_id"] for r in some} == {"2", "7"}
    empty = warc.write_archives(pages(spark, []), common.shared_path(spark, "warctest"))
    assert warc.read_records(empty, folder).count() == 0


def test_estimates_against_exact_sets():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 3000)]
    a, b = " ".join(words[:2000]), " ".join(words[500:2600])
    x, y = fingerprints.sketches([a.encode(), b.encode()])
    exact = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs(fingerprints.resemblance(x, y) - exact) < 0.1
    assert abs(fingerprints.containment(x, y) - len(shingles(a) & shingles(b)) / len(shingles(a))) < 0.15
    assert abs(fingerprints.distinct_shingles(x) / len(shingles(a)) - 1) < 0.2
    assert np.array_equal(fingerprints.merge(x, y), fingerprints.merge(y, x)) and np.array_equal(fingerprints.from_text(fingerprints.to_text(x)), x)
    none = np.zeros(0, np.uint64)
    assert fingerprints.resemblance(none, none) == 1 and fingerprints.resemblance(none, x) == 0


def test_edits_follow_the_next_document(spark):
    docs = odd_documents(spark)
    found = {r["doc_id"]: r for r in fingerprints.edit_study(docs).collect()}
    texts = [t or "" for t in ODD_TEXTS]
    for i, text in enumerate(texts):
        following = texts[i - 1]
        half = len(text) // 2
        new = text[:len(text) - half] + following[:half]
        assert found[i]["edited_text"] == new and found[i]["n_chars"] == len(text)
        a, b, c = (shingles(t) for t in (text, new, following))
        assert abs(found[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.01
        assert abs(found[i]["near_next"] - (len(a & c) / len(a | c) if a | c else 1)) < 0.01
    assert found[None]["near_next"] is None and found[6]["fingerprint"] == found[7]["fingerprint"]
    assert fingerprints.edit_study(empty_documents(spark)).count() == 0
    assert fingerprints.edit_study(docs.where("doc_id = 5")).collect()[0]["near_next"] == 1


def test_parts_merge_into_the_whole(spark):
    parts = spark.createDataFrame([(1, PROSE * 2), (1, "another text of some more words than five"), (2, None)], "k long, text string")
    prints = fingerprints.with_fingerprints(parts).select("row.k", "out.fingerprint")
    merged = {r["k"]: r["fingerprint"] for r in fingerprints.merged_fingerprints(prints, "k").collect()}
    x, y = fingerprints.sketches([(PROSE * 2).encode(), b"another text of some more words than five"])
    assert merged == {1: fingerprints.to_text(fingerprints.merge(x, y)), 2: ""}
    pair = prints.where("k = 1").selectExpr("max(fingerprint) AS a", "min(fingerprint) AS b")
    assert pair.select(fingerprints.likeness(pair["a"], pair["b"])).first()[0] == 0
