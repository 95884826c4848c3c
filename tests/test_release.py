"""File digests in ranges, released files, and records that are there once."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sealcheck.operators import discovery, triage
from sealcheck.sources import digests, sinks
from sealcheck.streaming import incremental
from sealcheck.tables import FALLBACK_NOTE
from tests.dialogue import packet, typed


def test_digests_of_a_folder(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    contents = {"a.pcap": b"", "deep/b.pcap": b"x" * 70_000, "deep/er/c.cap": bytes(range(256)) * 999}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = {os.path.relpath(r["path"], tmp_path): (r["length"], r["sha256"]) for r in digests.file_digests(spark, f"file://{tmp_path}").collect()}
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    one = digests.file_digests(spark, str(tmp_path / "a.pcap")).collect()
    assert [(r["length"], r["sha256"]) for r in one] == [(0, hashlib.sha256(b"").hexdigest())]


def test_a_file_beyond_the_size_of_a_row(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "large.pcap", "wb") as file:       # sparse: takes no room
        file.truncate(size)
    zeros, digest = bytes(1 << 20), hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(zeros)
    digest.update(zeros[:size & (1 << 20) - 1])
    row = digests.file_digests(spark, str(tmp_path)).first()
    assert (row["length"], row["sha256"]) == (size, digest.hexdigest())


def test_files_are_dealt_by_size(tmp_path, monkeypatch):
    for i in range(7):
        (tmp_path / f"{i}.cap").write_bytes(b"x" * 10)
    monkeypatch.setattr(digests, "TASK_BYTES", 25)
    parts = digests.FileDigestReader(str(tmp_path)).partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 2, 1]


def test_release_lists_the_files_that_ship(spark):
    features = spark.createDataFrame([("a", "LOW"), ("a", None), ("b", "HIGH")], "capture string, risk_label string")
    files = spark.createDataFrame([("a", "/x/a", 3, "aa"), ("b", "/x/b", 4, "bb")], "capture string, path string, length long, sha256 string")
    twice = spark.createDataFrame([("a",), ("a",)], "capture string")
    parts = sinks.release(features, features.select("capture").distinct(), twice, files)
    assert [tuple(r) for r in parts["files"].collect()] == [("a", "/x/a", 3, "aa")]
    assert parts["totals"].first().asDict() == {"kept": 2, "dropped": 1} and parts["captures"].count() == 1
    assert {tuple(r) for r in parts["labels"].collect()} == {("LOW", 1), ("?", 1)}


def lines(n, start=1):
    return "\n".join(json.dumps(packet(i, 25, 40000)) for i in range(start, start + n))


def test_a_killed_run_leaves_no_second_record(spark, tmp_path, monkeypatch):
    source, records = tmp_path / "in", str(tmp_path / "records")
    source.mkdir()

    def analyse(packets):
        return packets.groupBy(F.col("capture").alias("path")).agg(F.count("*").alias("packets"))

    def run():
        incremental.run_recorded(spark, str(source), str(tmp_path / "state"), records, analyse)

    def held():
        return sorted((r["path"].split("/")[-1], r["packets"]) for r in incremental.read_records(spark, records).collect())

    (source / "one.json").write_text(lines(3))
    run()
    (source / "two.json").write_text(lines(2))
    written = incremental.record_batch

    def killed(*given):         # between the write and the checkpoint's note of it
        written(*given)
        raise RuntimeError("killed")

    monkeypatch.setattr(incremental, "record_batch", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(incremental, "record_batch", written)
    (source / "three.json").write_text(lines(1))
    run()
    assert held() == [("one.json", 3), ("three.json", 1), ("two.json", 2)]
    run()
    assert held() == [("one.json", 3), ("three.json", 1), ("two.json", 2)]
    os.remove(f"{records}/batch=1/_SUCCESS")        # a batch that was never finished is not read
    assert ("two.json", 2) not in held()


def test_fallback_says_why(spark):
    rows = spark.createDataFrame([("c", "s1", "LOW"), ("c", "s2", "HIGH")], "capture string, session_id string, policy_risk_class string")
    guess = spark.createDataFrame([("c", "s1", "MEDIUM", None), ("c", "s2", None, "ValueError")], "capture string, session_id string, ml_class string, ml_error string")
    found = {r["session_id"]: r for r in triage.rule_fallback(rows, guess, triage.schema_fingerprint()).collect()}
    assert (found["s1"]["ml_class"], found["s1"]["ml_note"]) == ("MEDIUM", None)
    assert found["s2"]["ml_class"] == "HIGH" and found["s2"]["ml_version"] == f"rule-fallback ({found['s1']['ml_version']})"
    assert found["s2"]["ml_note"] == f"{FALLBACK_NOTE} ML prediction fallback: ValueError"
    broken = triage.rule_fallback(rows, load_error="EOFError").first()
    assert broken["ml_version"] == "rule-fallback (load_failed)" and broken["ml_note"].endswith("could not be read: EOFError")
    assert triage.rule_fallback(rows).first()["ml_version"] == "rule-fallback (not_loaded)"


def test_leftover_name_is_the_raw_one(spark):
    asked = packet(1, 40000, 9993, stream="4", tls={"tls.handshake.type": "1", "tls.handshake.extensions.server_name_len": "9",
                                                   "tls.handshake.extensions_server_name": " localhost,x "})
    assert discovery.unclassified_tls(typed(spark, [asked])).first()["server_name"] == "localhost"
