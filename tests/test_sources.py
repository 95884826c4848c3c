import json

import pyarrow as pa
from pyspark.sql import functions as F

from sealcheck.plans import posture
from sealcheck.sources import captures, packets, sinks
from sealcheck.streaming import incremental
from tests.dialogue import ANSWER, ASKS, GREETING, HELLO, dialogue

PACKETS = dialogue(143, GREETING, ASKS, ("c", HELLO), ("s", ANSWER))


def signature(df):
    return [(r["packet_no"], r["fields"]) for r in df.orderBy("packet_no").collect()]


def test_json_layouts_agree(spark, tmp_path):
    texts = {"lines": "\n".join(json.dumps(p) for p in PACKETS), "pretty": json.dumps(PACKETS, indent=2),
             "document": json.dumps({"packets": PACKETS})}
    read = {}
    for layout, text in texts.items():
        folder = tmp_path / layout
        folder.mkdir()
        (folder / "one.json").write_text(text)
        read[layout] = signature(packets.read_packets(spark, str(folder), layout))
    assert read["lines"] == read["pretty"] == read["document"] and len(read["lines"]) == len(PACKETS)


def test_large_pretty_file_is_split_and_numbered(spark, tmp_path):
    many = [dict(_source={"layers": {"frame": {"frame.number": str(i)}}}) for i in range(1, 400)]
    (tmp_path / "big.json").write_text(json.dumps(many, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        texts = packets.packet_lines(spark, str(tmp_path), "pretty")
        assert texts.select("block").distinct().count() > 4
        rows = packets.numbered(texts).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["packet_no"] for r in rows) == list(range(1, 400))
    assert all(r["fields"][0]["value"] == str(r["packet_no"]) for r in rows)


def test_nested_values_keep_document_order(spark):
    doc = {"a": {"B_c": ["1", {"d": "2"}, ["3"]], "empty": "", "none": None}, "b": 4}
    rows = spark.createDataFrame([("c", 1, json.dumps(doc)), ("c", 2, "{broken")], "capture string, packet_no long, json string")
    got = {r["packet_no"]: r["fields"] for r in packets.flatten_packets(rows).collect()}
    assert [(f["key"], f["value"]) for f in got[1]] == [("a.b.c", "1"), ("a.b.c.d", "2"), ("a.b.c", "3"), ("b", "4")]
    assert got[2] is None


def test_field_rows(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("1\t25\t5000\t2,11\n2\t\t5000\t\n")
    rows = packets.read_packet_columns(spark, str(tmp_path), ["stream", "src", "dst", "types"], ("types",)).orderBy("stream").collect()
    assert rows[0]["types"] == ["2", "11"] and rows[1]["src"] is None


def test_manifest_and_resume(spark, tmp_path):
    for name in ("a.pcap", "b.PCAPNG", "sub/c.cap.gz", "reports/d.pcap", "e.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * 3)
    found = captures.capture_manifest(captures.list_files(spark, str(tmp_path)))
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.pcap", "b.PCAPNG", "c.cap.gz"]
    digests = captures.with_sha256(captures.read_files(spark, str(tmp_path))).select("sha256", "size_bytes").distinct().collect()
    assert len(digests) == 1 and digests[0]["size_bytes"] == 3
    done = found.limit(1).select("path", F.lit(True).alias("ok")).unionByName(found.select("path", F.lit(False).alias("ok")))
    assert captures.pending(found, done).count() == 2 and captures.pending(found, done, limit=2).count() == 1


def test_records_and_analyses(spark, tmp_path):
    rows = spark.createDataFrame([("x1", "3.2.0", 5), ("x2", "3.1.0", 6)], "analysis_id string, analyzer_version string, n int")
    sinks.save_analysis(rows, str(tmp_path / "store"))
    assert sinks.load_analysis(spark, str(tmp_path / "store"), "x2").first()["n"] == 6
    sinks.write_captures(rows, str(tmp_path / "records"))
    sinks.write_captures(rows, str(tmp_path / "records"))
    assert spark.read.json(str(tmp_path / "records")).count() == 4
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == rows.columns


def test_each_file_is_processed_once(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()

    def handle(batch, _):
        seen.extend(r["capture"] for r in posture.type_packets(batch).select("capture").collect())

    for name in ("one.json", "two.json"):
        (source / name).write_text("\n".join(json.dumps(p) for p in PACKETS))
        incremental.run_pending(spark, str(source), str(tmp_path / "state"), handle)
    assert sorted(c.split("/")[-1] for c in seen) == ["one.json"] * len(PACKETS) + ["two.json"] * len(PACKETS)


def test_files_of_one_name_stay_apart_and_broken_lines_are_failures(spark, tmp_path):
    for folder, port in (("a", 25), ("b", 143)):
        (tmp_path / folder).mkdir()
        lines = [json.dumps(p) for p in dialogue(port, GREETING, ASKS)]
        (tmp_path / folder / "cap.json").write_text("\n".join([lines[0], "{broken", lines[1]]))
    path = f"{tmp_path}/*"
    rows = packets.read_packets(spark, path)
    assert sorted((r["capture"].split("/")[-2], r["packet_no"]) for r in rows.collect()) == [("a", 1), ("a", 3), ("b", 1), ("b", 3)]
    assert {r["n"] for r in rows.select(packets.capture_name(F.col("capture")).alias("n")).collect()} == {"cap.json"}
    assert sorted((r["path"].split("/")[-2], r["packet_no"]) for r in packets.read_failures(spark, path).collect()) == [("a", 2), ("b", 2)]
    found = posture.scored_sessions(posture.type_packets(rows)).select("server_port", "packet_count").collect()
    assert sorted(map(tuple, found)) == [(25, 2), (143, 2)]


def test_fields_are_laid_out_in_small_pieces():
    texts = [json.dumps({"_source": {"layers": {"A_b": [str(i), {"c": i}], "tcp": {"tcp.len": i % 7}}}}) for i in range(1_300)]
    texts[3], texts[4] = "{broken", "[]"
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["json"])
    pieces = list(packets._pieces([batch]))
    assert max(p.num_rows for p in pieces) <= packets.FIELD_ROWS
    got = [row for p in pieces for row in packets._fields_of(p["json"]).to_pylist()]
    want = [None if t == "{broken" else [] if t == "[]" else [{"key": "a.b", "value": str(i)}, {"key": "a.b.c", "value": str(i)}, {"key": "tcp.tcp.len", "value": str(i % 7)}]
            for i, t in enumerate(texts)]
    assert got == want
