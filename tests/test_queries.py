"""A cross-section of the registered queries against DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import compare

SOME = ["S8_feature_table", "S9_split_failures", "T2_field_values", "T13_tls_flags", "T15_upgrade_verdict", "D3_port_votes", "D6_discovered_ports",
        "D7_merge_passes", "D8_unclassified_tls", "D10_capture_state", "A5_duration_ms", "A8_starttls_response", "A14_negotiated_cipher", "C6_attach_certificate",
        "C7_chain_status", "R0_assess_sessions", "G6_capture_summary", "G8_recommendations", "M3_stratified_split", "M13_feature_ranges", "M15_novelty_capture",
        "E5_score_summary", "E9_failed_expectations", "E10_capability_verdict", "Q8_search"]


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_duckdb(spark, small_dir, name):
    ok, note, _ = compare.compare(spark, compare.connect(small_dir), small_dir, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_statement_has_a_query():
    queries, statements = set(entry.queries()), set(entry.oracle_sql())
    assert statements <= queries
    own = {name for name in queries - statements if not name.startswith("op") and name != "pipeline"}
    assert own == {"M6_fit_anomaly", "M7_score_anomaly", "P1_analyse"}


@pytest.mark.parametrize("name", ["E1_match_expected", "E5_score_summary", "M5_score_risk", "M7_score_anomaly", "M8_rule_fallback", "M12_transfer_test",
                                  "M14_novelty_session", "M15_novelty_capture"])
def test_sessions_are_computed_once(spark, small_dir, name):
    """What a query reads several times is staged: its own plan has no packets left."""
    files = entry.queries()[name](spark, small_dir).inputFiles()
    assert files and not [f for f in files if "events.parquet" in f]


def test_models(spark, small_dir):
    from checks import spark_queries as sq
    from sealcheck.operators import anomaly, triage
    rows = sq.scored(spark, small_dir)
    model = triage.fit_risk(triage.training_frame(rows, "policy_risk_class"), trees=20)
    scored = triage.score_risk(rows.drop("ml_class"), model)
    total = triage.agreement(scored.withColumn("all", sq.F.lit(1)), "all").first()
    assert total["accuracy"] > 0.8
    forest = anomaly.fit_anomaly(rows, ["capture", "session_id"], trees=30)
    flagged = anomaly.score_anomaly(rows, forest).selectExpr("avg(CAST(ml_anomalous AS INT)) AS share", "min(ml_anomaly_score) AS low", "max(ml_anomaly_score) AS high").first()
    assert 0.02 <= flagged["share"] <= 0.1 and 0 <= flagged["low"] <= flagged["high"] <= 1


def test_certificates_are_read_without_repeating_the_packets_expressions(spark, small_dir):
    from checks import views
    from sealcheck.operators import certificates

    packets = views.typed_packets(spark, small_dir)
    plan = certificates.sent_certificates(packets)._jdf.queryExecution().optimizedPlan().toString()
    assert max([len(line) for line in plan.split("\n") if "Filter" in line], default=0) < 2000
    odd = spark.createDataFrame([("c", s, n, t, v) for n, (s, t, v) in enumerate([
        ("1", True, ["30" * 60, "31" * 60]), ("1", False, ["30" * 60]), ("1", None, ["30" * 60]), ("2", True, None), ("2", True, []), (None, True, ["3081" * 40])])],
        "capture string, stream_id string, packet_no long, is_tls boolean, cert_values array<string>")
    assert sorted((r["stream_id"], r["packet_no"], r["slot"]) for r in certificates.sent_certificates(odd).collect()) == [("1", 0, 0), ("unknown-5", 5, 0)]
