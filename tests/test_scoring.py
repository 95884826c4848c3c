"""Three demo sessions with worked-out results."""

import pytest
from pyspark.sql import functions as F

from sealcheck.operators import rules, scoring, triage
from sealcheck.sources import sinks

BASE = dict(
    capture="demo", session_id="", stream_id="", first_frame=1, protocol="SMTP", server_port=587, packet_count=10, tls_detected=True,
    implicit_tls=False, plaintext_auth=False, starttls_command=True, starttls_advertised=True, starttls_rejected=False,
    upgrade_successful=True, starttls_evidence=["said"], tls_version="TLS 1.3", cipher_suite="TLS_AES_256_GCM_SHA384 (0x1302)", cipher_known=True,
    key_exchange="X25519", forward_secrecy=True, handshake_status="COMPLETE", alert_seen=False, handshake_failures=0, sni="mail.example.test",
    cert_present=True, cert_expired=False, cert_not_yet_valid=False, cert_days_remaining=280, cert_key_algorithm="RSA", cert_key_bits=2048,
    cert_weak_signature=False, cert_self_signed=False, cert_hostname_match=True, cert_chain_complete=True, cert_chain_status="COMPLETE",
    cert_subject="CN=a", cert_common_name="a", cert_signature_algorithm="sha256-RSA", cert_valid_from_epoch=1, cert_valid_until_epoch=2)
WEAK = dict(
    BASE, session_id="weak", first_frame=100, protocol="IMAP", server_port=143, tls_version="TLS 1.0", cipher_suite="TLS_RSA_WITH_3DES_EDE_CBC_SHA (0x000a)",
    key_exchange="RSA", forward_secrecy=False, handshake_failures=1, cert_expired=True, cert_days_remaining=-10, cert_key_bits=1024,
    cert_weak_signature=True, cert_self_signed=True, cert_hostname_match=False, cert_chain_complete=False, cert_chain_status="INCOMPLETE")
PLAIN = dict(
    BASE, session_id="plain", first_frame=200, protocol="POP3", server_port=110, tls_detected=False, plaintext_auth=True, starttls_command=False,
    starttls_advertised=False, upgrade_successful=False, tls_version=None, cipher_suite=None, cipher_known=False, forward_secrecy=None,
    handshake_status="UNKNOWN", cert_present=False)


@pytest.fixture(scope="module")
def demo(spark):
    from pyspark.sql import types as T
    kinds = {bool: T.BooleanType(), int: T.LongType(), str: T.StringType(), list: T.ArrayType(T.StringType())}
    schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in BASE.items()])
    rows = [tuple(d[k] for k in BASE) for d in (dict(BASE, session_id="secure"), WEAK, PLAIN)]
    return scoring.score_sessions(rules.assess_sessions(spark.createDataFrame(rows, schema))).withColumn("ml_class", F.col("policy_risk_class"))


def test_demo_sessions(demo):
    got = {r["session_id"]: r for r in demo.collect()}
    assert got["secure"]["findings"] == [] and got["secure"]["policy_risk_class"] == "LOW" and got["secure"]["policy_risk_score"] == 0
    assert [f["code"] for f in got["weak"]["findings"]] == [
        "DEPRECATED_TLS_VERSION", "LEGACY_CIPHER", "NO_FORWARD_SECRECY", "CERTIFICATE_EXPIRED", "WEAK_CERTIFICATE_KEY",
        "WEAK_CERTIFICATE_SIGNATURE", "SELF_SIGNED_CERTIFICATE", "CERTIFICATE_HOSTNAME_MISMATCH", "INCOMPLETE_CERTIFICATE_CHAIN",
        "TLS_HANDSHAKE_INSTABILITY"]
    assert got["weak"]["policy_risk_score"] == 100 and got["weak"]["policy_risk_class"] == "CRITICAL"
    assert [(f["code"], f["severity"]) for f in got["plain"]["findings"]] == [
        ("PLAINTEXT_EMAIL_SESSION", "HIGH"), ("PLAINTEXT_AUTHENTICATION", "CRITICAL")]
    assert got["plain"]["policy_risk_score"] == 75 and all(r["evidence_completeness"] == 1.0 for r in got.values())


def test_demo_capture(demo):
    s = scoring.capture_summary(demo).first()
    assert (s["total_sessions"], s["tls_sessions"], s["plaintext_sessions"], s["total_findings"]) == (3, 2, 1, 12)
    assert s["findings_by_severity"] == {"INFO": 0, "LOW": 0, "MEDIUM": 4, "HIGH": 6, "CRITICAL": 2}
    assert (s["overall_risk_score"], s["overall_posture_score"], s["overall_risk_class"]) == (58, 42, "CRITICAL")
    assert s["protocols"] == {"SMTP": 1, "IMAP": 1, "POP3": 1} and s["evidence_completeness"] == 1.0
    assert s["tls_versions"] == {"TLS 1.0": 1, "TLS 1.3": 1} and len(s["ciphers"]) == 2


def test_unknown_evidence_is_not_a_weakness(demo):
    bare = demo.filter("session_id = 'secure'").drop("findings").withColumn("cert_present", F.lit(False)) \
        .withColumn("forward_secrecy", F.lit(None).cast("boolean")).withColumn("cert_expired", F.lit(None).cast("boolean"))
    r = scoring.score_sessions(rules.assess_sessions(bare)).first()
    assert r["policy_risk_score"] == 0 and r["policy_risk_class"] == "LOW" and r["evidence_completeness"] == 0.8
    assert {f["code"] for f in r["findings"]} == {"FORWARD_SECRECY_UNKNOWN", "CERTIFICATE_NOT_OBSERVED"}


def test_top_findings_and_advice(demo):
    top = scoring.top_findings(demo).orderBy("rank").collect()
    assert [t["code"] for t in top][:3] == ["DEPRECATED_TLS_VERSION", "PLAINTEXT_AUTHENTICATION", "LEGACY_CIPHER"] and len(top) == 5
    advice = scoring.recommendations(demo).orderBy("position").collect()
    assert len(advice) == 12 + 5 and advice[0]["advice"].startswith("Disable SSLv3") and advice[-1]["advice"].startswith("Require authentication")
    flat = scoring.flatten_findings(demo).collect()
    assert [f["severity"] for f in flat] == ["CRITICAL"] * 2 + ["HIGH"] * 6 + ["MEDIUM"] * 4


def test_flat_csv(demo):
    row = sinks.capture_csv(scoring.batch_record(demo)).first()
    assert len(row) == 25 and row["protocols"] == "IMAP=1; POP3=1; SMTP=1" and row["ml_matches_rules"] == 3
    assert row["top_findings"].startswith("CRITICAL:DEPRECATED_TLS_VERSION | CRITICAL:PLAINTEXT_AUTHENTICATION")


def test_class_and_band(spark):
    rows = spark.createDataFrame([(["INFO", "LOW"], 8), (["MEDIUM"], 18), (["HIGH", "MEDIUM"], 48), (["MEDIUM"] * 5, 90), ([], 0)],
                                 "s array<string>, n int")
    got = rows.select(scoring.risk_class(F.col("s"), F.col("n")).alias("c"), scoring.risk_band(F.col("n")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("LOW", "LOW"), ("MEDIUM", "MEDIUM"), ("HIGH", "HIGH"), ("CRITICAL", "CRITICAL"), ("LOW", "LOW")]


def test_fallback_without_current_model(demo):
    guess = demo.select("capture", "session_id", F.lit("LOW").alias("ml_class"))
    rows = demo.drop("ml_class")
    stale = triage.rule_fallback(rows, guess, "other").select("policy_risk_class", "ml_class", "ml_version").collect()
    assert all(r["policy_risk_class"] == r["ml_class"] and r["ml_version"] == "rule-fallback (stale)" for r in stale)
    fresh = triage.rule_fallback(rows, guess, triage.schema_fingerprint()).select("ml_class").collect()
    assert all(r["ml_class"] == "LOW" for r in fresh)
