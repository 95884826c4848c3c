"""Streams folded in runs give the same sessions as streams folded whole, and as a plain loop."""

import random

from pyspark.sql import functions as F

from sealcheck.operators import certificates, sessions
from sealcheck.schemas import PACKET_SCHEMA

TEXTS_C = [None, "a1 STARTTLS", "b2 STARTTLS", "STARTTLS", "x LOGIN u p", "noop"]
TEXTS_S = [None, "a1 OK go", "b2 NO never", "* OK [CAPABILITY STARTTLS] hi", "a1 BAD x", "x OK done", "* BYE"]


def random_packets(seed=5, streams=40, longest=60):
    rng, rows, number = random.Random(seed), [], 0
    plan = [(s, rng.randint(1, longest)) for s in range(streams)]
    queue = [s for s, n in plan for _ in range(n)]
    rng.shuffle(queue)
    for stream in queue:
        number += 1
        client = rng.random() < 0.5
        port = 143 if stream % 3 else 9999
        text = rng.choice(TEXTS_C if client else TEXTS_S)
        tls = rng.random() < 0.03
        rows.append(dict(
            capture="c", packet_no=number, stream_id=str(stream), frame=number,
            ts_us=None if rng.random() < 0.2 else rng.randint(0, 40_000_000_000), rel_s=None,
            src_ip=None if rng.random() < 0.1 else "a", dst_ip="b", src_port=5000 if client else port, dst_port=port if client else 5000,
            frame_len=rng.randint(1, 99), retransmission=rng.random() < 0.2, layer_protocol="IMAP" if text else None,
            has_mail_layer=bool(text), mail_text=text, is_tls=tls, client_hello=tls and rng.random() < 0.5, server_hello=False,
            hs_types=[], versions=["TLS 1.2"] if tls else [], supported_version=None, legacy_version=None,
            ciphers=rng.sample(["0xc02f", "0x00ff", "0x1301", "0x1302", "0x002f"], 3) if tls else [], sni=None, key_group=None,
            cert_values=[], alert=False, failure=False, payload_hex=None))
    return rows


def sequential(rows):
    """Upgrade answers and credentials of one stream, packet by packet."""
    hint = 143 if any(143 in (r["src_port"], r["dst_port"]) for r in rows) else None
    first = next((r for r in rows if r["src_ip"]), None)
    state = dict(cmd=None, first_cmd=None, tag=None, waiting=False, yes=False, no=False, tls=None, auth=False)
    for i, r in enumerate(rows, 1):
        if r["is_tls"] and state["tls"] is None:
            state["tls"] = i
        if hint and hint in (r["src_port"], r["dst_port"]):
            client = r["dst_port"] == hint
        else:
            client = r["src_port"] == first["src_port"] if first else True
        text = r["mail_text"]
        if not text:
            continue
        if client:
            words = text.split()
            if "STARTTLS" in text:
                state["cmd"], state["waiting"] = i, True
                state["first_cmd"] = state["first_cmd"] or i
                if len(words) == 2 and hint:
                    state["tag"] = words[0]
            if "LOGIN" in words and hint and (state["tls"] is None or i < state["tls"]):
                state["auth"] = True
        elif state["waiting"]:
            if i - state["cmd"] > 4:
                state["waiting"] = False
                continue
            words = text.split()
            if len(words) < 2 or "CAPABILITY" in text or words[1] not in ("OK", "NO", "BAD") or (state["tag"] and words[0] != state["tag"]):
                if not (text == "* BYE" and not state["tag"]):
                    continue
            state["yes" if words[1] == "OK" else "no"] = True
            state["waiting"] = False
    reached = state["first_cmd"] is not None and state["tls"] is not None and state["first_cmd"] <= state["tls"]
    return state["yes"], state["no"], state["auth"], reached


def test_runs_equal_whole_streams_and_the_loop(spark):
    rows = random_packets()
    packets = spark.createDataFrame([tuple(r.get(f) for f in PACKET_SCHEMA.fieldNames()) for r in rows], PACKET_SCHEMA)
    whole = {r["stream_id"]: r.asDict(True) for r in sessions.sessionise(packets, split_above=None).collect()}
    runs = {r["stream_id"]: r.asDict(True) for r in sessions.sessionise(packets, split_above=15, run_packets=7).collect()}
    assert set(whole) == set(runs)
    for stream in whole:
        assert whole[stream] == runs[stream], stream
    for stream, session in whole.items():
        mine = [r for r in rows if r["stream_id"] == stream]
        got = session["answered_yes"], session["answered_no"], session["plaintext_auth"], \
            session["upgrade_successful"]
        assert got == sequential(mine), stream


def test_index_of_split_streams(spark):
    rows = random_packets(seed=9, streams=6, longest=50)
    packets = spark.createDataFrame([tuple(r.get(f) for f in PACKET_SCHEMA.fieldNames()) for r in rows], PACKET_SCHEMA)
    cut = sessions.long_streams(packets, 10)
    got = sessions.ordered_rows(sessions.packet_events(packets), cut, 8).filter(~F.col("copy")).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["packet_no"]):
        seen[r["stream_id"]] = seen.get(r["stream_id"], 0) + 1
        assert r["packet_index"] == seen[r["stream_id"]]
    assert len(got) == len(rows)


def test_chain_in_runs(spark):
    certs = spark.createDataFrame([(f"f{i}", f"CN={i}", f"CN={i + 1}") for i in range(20)] + [("root", "CN=20", "CN=20")],
                                  "fingerprint string, subject string, issuer string")
    sent = [("c", "1", i, 0, f"f{i}") for i in range(20)] + [("c", "1", 20, 0, "root")]
    sent += [("c", "2", 0, 0, "f3"), ("c", "2", 9, 0, "f9"), ("c", "3", 5, 0, "root"), ("c", "4", 5, 0, "f1"),
             ("c", "5", 1, 0, "f1"), ("c", "5", 1, 1, "unreadable"), ("c", "5", 8, 0, "f2")]
    table = spark.createDataFrame(sent, "capture string, stream_id string, packet_no long, slot int, fingerprint string")
    for run in (1, 3, 1000):
        got = {r["stream_id"]: (r["chain_length"], r["chain_status"], r["chain_complete"])
               for r in certificates.chain_status(table, certs, run).collect()}
        assert got == {"1": (21, "COMPLETE", True), "2": (2, "INCOMPLETE", False), "3": (1, "SELF_SIGNED", True),
                       "4": (1, "INCOMPLETE", False), "5": (2, "COMPLETE_UNVERIFIED_ROOT", True)}
