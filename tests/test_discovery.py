from pyspark.sql import functions as F

from sealcheck.functions import mailtext as mt
from sealcheck.operators import discovery, sessions
from sealcheck.plans import posture
from tests.dialogue import CLIENT, HELLO, packet, typed


def payloads(spark, *rows):
    data = [("c", i, src, dst, text.encode("latin-1").hex()) for i, (src, dst, text) in enumerate(rows)]
    return spark.createDataFrame(data, "capture string, packet_no long, src_port int, dst_port int, payload_hex string")


def found(spark, *rows):
    return {r["port"]: r["protocol"] for r in discovery.discovered_ports(payloads(spark, *rows)).collect()}


GREETING = "* OK [CAPABILITY IMAP4rev1] ready\r\n"


def test_greeting_names_the_port(spark):
    assert found(spark, (8143, CLIENT, GREETING), (CLIENT, 8143, "A001 CAPABILITY\r\n")) == {8143: "IMAP"}


def test_known_port_and_thin_evidence(spark):
    assert found(spark, (143, CLIENT, GREETING), (CLIENT, 143, "A001 CAPABILITY\r\n")) == {}
    assert found(spark, (9000, CLIENT, "* OK\r\n")) == {}


def test_two_greeted_ports_are_both_kept(spark):
    got = found(spark, (2525, 5000, "220 mail.lab.test ESMTP ready"), (5000, 2525, "EHLO client"),
                (8143, 5001, GREETING), (5001, 8143, "A001 LOGIN alice secret"))
    assert got == {2525: "SMTP", 8143: "IMAP"}


def test_vocabulary_counts_like_str_count(spark):
    from sealcheck.tables import MAIL_VOCABULARY
    texts = ["220 220 220 ehlo EHLO starttls\r\nauth plain", "* ok * OK capability a001 login x", "+ok +OK stls user a", "", "ÄÖ 250-250-"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mt.vocabulary_scores(F.col("t")).alias("s")).collect()
    for r in rows:
        for part in r["s"]:
            assert part["score"] == sum(r["t"].lower().count(w) for w in MAIL_VOCABULARY[part["protocol"]])


def test_mixed_ports_survive_both_passes(spark):
    hexed = lambda t: {"tcp.payload": t.encode().hex()}
    standard = [packet(1, 587, 5000, smtp={"smtp.response": "250 go on"}), packet(2, 5000, 587, smtp={"smtp.req.command": "NOOP"})]
    unusual = [packet(3, 8143, 5001, stream="1"), packet(4, 5001, 8143, stream="1")]
    unusual[0]["_source"]["layers"]["tcp"].update(hexed("* OK [CAPABILITY IMAP4rev1] ready"))
    unusual[1]["_source"]["layers"]["tcp"].update(hexed("A001 LOGIN alice secret"))
    got = posture.two_pass_sessions(typed(spark, standard + unusual)).collect()
    assert [(r["server_port"], r["protocol"], r["plaintext_auth"]) for r in got] == [(587, "SMTP", False), (8143, "IMAP", True)]


def test_leftover_stream_is_described_not_named(spark):
    packets = [packet(1, CLIENT, 9993, stream="4", **HELLO),
               packet(2, 9993, CLIENT, stream="4", tls={"tls.handshake.type": "2,11", "tls.handshake.version": "0x0301"})]
    streams = discovery.unclassified_tls(typed(spark, packets))
    row = streams.withColumn("d", discovery.stream_description()).first()
    assert row["server_port"] == 9993 and row["tls_version"] == "TLS 1.0" and row["tls_version_source"] == "SERVER_HELLO_LEGACY"
    assert row["d"] == "port 9993, TLS 1.0 (from SERVER_HELLO_LEGACY), client asked for mail.lab.test, certificate visible"
    note = discovery.unclassified_note(streams).first()["note"]
    assert "9993" in note and "cannot be proven" in note
    none = sessions.sessionise(discovery.mail_scope(typed(spark, packets)))
    captures = spark.createDataFrame([("capture",), ("empty",)], "capture string")
    states = discovery.capture_state(captures, typed(spark, packets), none, streams)
    assert {r["capture"]: r["state"] for r in states.collect()} == {"capture": "UNCLASSIFIED", "empty": "UNREADABLE"}


def test_whole_analysis_has_a_row_for_every_capture(spark):
    hexed = lambda t: {"tcp.payload": t.encode().hex()}
    unusual = [packet(1, 8143, 5001, stream="1"), packet(2, 5001, 8143, stream="1"), packet(3, CLIENT, 443, stream="2", **HELLO)]
    unusual[0]["_source"]["layers"]["tcp"].update(hexed("* OK [CAPABILITY IMAP4rev1] ready"))
    unusual[1]["_source"]["layers"]["tcp"].update(hexed("A001 LOGIN alice secret"))
    packets = typed(spark, unusual, "mail").unionByName(typed(spark, [packet(1, CLIENT, 443, stream="4", **HELLO)], "web")) \
        .unionByName(typed(spark, [packet(1, CLIENT, 80)], "plain"))
    captures = spark.createDataFrame([("empty",)], "capture string")
    failures = spark.createDataFrame([("broken", "no packets")], "path string, error string")
    done = posture.analyse(packets, captures=captures, failures=failures)
    rows = {r["capture"]: r for r in done.captures.collect()}
    assert {k: (r["state"], r["ok"], r["total_sessions"]) for k, r in rows.items()} == {
        "mail": ("SCORED", True, 1), "web": ("UNCLASSIFIED", True, 0), "plain": ("NO_SESSIONS", True, 0),
        "empty": ("UNREADABLE", False, 0), "broken": ("UNREADABLE", False, 0)}
    assert rows["broken"]["error"] == "no packets" and "443" in rows["web"]["unclassified_note"] and rows["mail"]["unclassified_streams"] == 1
    session = done.sessions.first()
    assert session["protocol"] == "IMAP" and session["policy_risk_class"] == session["ml_class"] == "CRITICAL"


def second_pass(spark, n=40):
    """A capture that holds every packet of two busy unusual ports, one with other ports, and one where the port means nothing."""
    hexed = lambda t: {"tcp.payload": t.encode().hex()}
    busy = []
    for i in range(n):
        pair = [packet(2 * i + 1, 8143, 5001 + i, stream=str(i)), packet(2 * i + 2, 5001 + i, 8143, stream=str(i))]
        pair[0]["_source"]["layers"]["tcp"].update(hexed("* OK [CAPABILITY IMAP4rev1] ready"))
        pair[1]["_source"]["layers"]["tcp"].update(hexed("A001 LOGIN alice secret"))
        busy += pair
    other = [packet(1, 2525, 6000, stream="1"), packet(2, 6000, 2525, stream="1")]
    other[0]["_source"]["layers"]["tcp"].update(hexed("220 mail.lab.test ESMTP ready"))
    other[1]["_source"]["layers"]["tcp"].update(hexed("EHLO client"))
    quiet = [packet(1, 8143, 7000, stream="1"), packet(2, 7000, 65535, stream="2"), packet(3, 2525, 0, stream="3")]
    return typed(spark, busy, "busy").unionByName(typed(spark, other, "other")).unionByName(typed(spark, quiet, "quiet"))


def test_second_pass_deals_no_packet_by_port(spark, monkeypatch):
    packets = second_pass(spark)
    discovered = discovery.discovered_ports(packets)
    assert {tuple(r) for r in discovered.collect()} == {("busy", 8143, "IMAP"), ("other", 2525, "SMTP")}
    extra = discovery.dissect_discovered(packets, discovered)
    plan = extra._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(capture" not in plan.split("BroadcastExchange")[0]
    got = sorted((r["capture"], r["packet_no"], r["layer_protocol"]) for r in extra.collect())
    assert len(got) == 82 and {(c, p) for c, _, p in got} == {("busy", "IMAP"), ("other", "SMTP")}
    monkeypatch.setattr("sealcheck.session.SMALL_SIDE_BYTES", -1)        # too large for a broadcast
    again = discovery.dissect_discovered(packets, discovered)
    assert sorted((r["capture"], r["packet_no"], r["layer_protocol"]) for r in again.collect()) == got
    sessions_found = posture.two_pass_sessions(packets).groupBy("capture", "protocol").count().collect()
    assert {tuple(r) for r in sessions_found} == {("busy", "IMAP", 40), ("other", "SMTP", 1)}


def test_port_bits(spark):
    ports = [0, 63, 64, 2525, 32767, 32768, 65535]
    bits = discovery.port_bits(spark.createDataFrame([("c", p, "SMTP") for p in ports], "capture string, port int, protocol string"))
    rows = spark.createDataFrame([(p,) for p in [*ports, 1, 62, 65, 2524, 65534, 70000, -1, None]], "p int")
    assert {r["p"] for r in rows.where(discovery.touches(bits, F.col("p"))).collect()} == set(ports)


def test_extra_ports_of_a_capture(spark):
    packets = second_pass(spark, 2)
    extra = spark.createDataFrame([("busy", 8143), ("other", 6000)], "capture string, port int")
    kept = discovery.mail_scope(packets, extra).groupBy("capture").count().collect()
    assert {tuple(r) for r in kept} == {("busy", 4), ("other", 2)}
