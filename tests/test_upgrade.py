"""STARTTLS/STLS, cipher and credential evidence."""

from tests.dialogue import ANSWER, ASKS, CLIENT, GREETING, HELLO, assess, codes, dialogue, imap, packet

YES = ("s", imap("response", ". OK begin"))
NO = ("s", imap("response", ". NO [PRIVACYREQUIRED] not now"))


def only(spark, *steps, port=143):
    sessions = assess(spark, dialogue(port, *steps))
    assert len(sessions) == 1
    return sessions[0]


def test_accepted_upgrade(spark):
    s = only(spark, GREETING, ASKS, YES, ("c", HELLO), ("s", ANSWER))
    assert s["protocol"] == "IMAP" and s["starttls_advertised"] and s["starttls_command"]
    assert s["starttls_accepted"] is True and s["starttls_rejected"] is False and s["upgrade_successful"]
    assert "STARTTLS_REJECTED" not in codes(s) and "PLAINTEXT_AUTHENTICATION" not in codes(s)
    assert s["cipher_suite"] == "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256 (0xc02f)" and s["cipher_source"] == "SERVER_HELLO"
    assert s["tls_version"] == "TLS 1.2" and s["forward_secrecy"] is True and s["sni"] == "mail.lab.test"
    assert not any("0x00ff" in c for c in s["offered_ciphers"]) and len(s["offered_ciphers"]) == 3
    assert s["cert_present"] and s["certificate_seen"] and s["policy_risk_score"] < 25


def test_rejected_upgrade(spark):
    s = only(spark, GREETING, ASKS, NO)
    assert s["starttls_accepted"] is False and s["starttls_rejected"] is True and not s["upgrade_successful"]
    assert "STARTTLS_REJECTED" in codes(s) and s["policy_risk_score"] >= 30


def test_refusal_before_a_real_handshake_is_not_a_rejection(spark):
    s = only(spark, GREETING, ASKS, NO, ("c", HELLO), ("s", ANSWER))
    assert s["upgrade_successful"] and s["starttls_rejected"] is False
    assert any("refusal response" in e for e in s["starttls_evidence"])


def test_answer_five_packets_later_is_no_answer(spark):
    quiet = ("c", {})
    near = only(spark, ASKS, quiet, quiet, quiet, NO)
    far = only(spark, ASKS, quiet, quiet, quiet, quiet, NO)
    assert near["starttls_accepted"] is False and far["starttls_accepted"] is None
    assert "STARTTLS_UPGRADE_NOT_COMPLETED" in codes(far)


def test_credentials_before_tls_only(spark):
    login = ("c", imap("request", ". LOGIN user secret"))
    early = only(spark, GREETING, login, ASKS, YES, ("c", HELLO), ("s", ANSWER))
    late = only(spark, GREETING, ASKS, YES, ("c", HELLO), ("s", ANSWER), login)
    assert early["plaintext_auth"] and "PLAINTEXT_AUTHENTICATION" in codes(early)
    assert not late["plaintext_auth"]


def test_cleartext_pop3(spark):
    s = only(spark, ("s", {"pop": {"pop.response": "+OK ready"}}),
             ("c", {"pop": {"pop.request.command": "USER", "pop.request.parameter": "alice"}}), port=110)
    assert s["protocol"] == "POP3" and not s["tls_detected"]
    assert {"PLAINTEXT_EMAIL_SESSION", "PLAINTEXT_AUTHENTICATION"} <= codes(s)
    assert s["policy_risk_class"] == "CRITICAL" and s["policy_risk_score"] == 75


def test_an_offer_is_not_a_negotiated_value(spark):
    s = only(spark, GREETING, ASKS, YES, ("c", HELLO))
    assert s["client_hello_seen"] and not s["server_hello_seen"]
    assert s["tls_version"] is None and s["cipher_suite"] is None and s["cipher_source"] == "CLIENT_OFFER"
    assert not s["cert_present"] and not {"DEPRECATED_TLS_VERSION", "INSECURE_CIPHER"} & codes(s)


def test_underscore_spelling_reads_the_same(spark):
    p = packet(1, CLIENT, 993, stream="7")
    p["_source"]["layers"] = {
        "frame": {"frame_frame_number": "1", "frame_frame_time_epoch": "1700000000.5", "frame_frame_len": "240"},
        "ip": {"ip_ip_src": "10.0.0.5", "ip_ip_dst": "10.0.0.6"},
        "tcp": {"tcp_tcp_stream": "7", "tcp_tcp_srcport": "40000", "tcp_tcp_dstport": "993"},
        "tls": {"tls_tls_handshake_type": "Server Hello", "tls_tls_handshake_version": "0x0303",
                "tls_tls_handshake_ciphersuite": "0xc02f"}}
    s = assess(spark, [p])[0]
    assert s["stream_id"] == "7" and s["start_us"] == 1700000000500000 and s["server_port"] == 993
    assert s["implicit_tls"] and s["upgrade_successful"] and s["tls_version"] == "TLS 1.2"


def test_message_bodies_are_never_read(spark):
    s = only(spark, GREETING, ("c", {"imap": {"imap.data.fragment": "a LOGIN user secret"}}))
    assert not s["plaintext_auth"]


def test_packets_without_stream_are_sessions_of_their_own(spark):
    p = [packet(i, CLIENT, 25) for i in (1, 2)]
    for x in p:
        del x["_source"]["layers"]["tcp"]["tcp.stream"]
    assert [s["session_id"] for s in assess(spark, p)] == ["tcp.stream.unknown-1", "tcp.stream.unknown-2"]
