"""Build dissected packets of one mail dialogue."""

import json

from sealcheck.plans import posture
from sealcheck.sources.packets import flatten_packets

CLIENT = 50123


def packet(number, src, dst, stream="0", **layers):
    return {"_source": {"layers": {
        "frame": {"frame.number": str(number), "frame.time_epoch": f"{1000 + number / 10:.1f}", "frame.len": "100"},
        "ip": {"ip.src": "10.0.0.1" if src == CLIENT else "10.0.0.2", "ip.dst": "10.0.0.2" if src == CLIENT else "10.0.0.1"},
        "tcp": {"tcp.stream": stream, "tcp.srcport": str(src), "tcp.dstport": str(dst)}, **layers}}}


def dialogue(port, *steps, stream="0"):
    """Steps are (side, layers) with side 'c' or 's'."""
    return [packet(i, *((CLIENT, port) if side == "c" else (port, CLIENT)), stream=stream, **layers)
            for i, (side, layers) in enumerate(steps, 1)]


HELLO = {"tls": {"tls.handshake.type": "1", "tls.handshake.version": "0x0303",
                 "tls.handshake.extensions.supported_version": ["0x0304", "0x0303"],
                 "tls.handshake.ciphersuite": ["0xc02f", "0xc030", "0x009c", "0x00ff"],
                 "tls.handshake.extensions.server_name": "mail.lab.test"}}
ANSWER = {"tls": {"tls.handshake.type": "2,11", "tls.handshake.version": "0x0303", "tls.handshake.ciphersuite": "0xc02f",
                  "tls.handshake.certificate": "30" + "00" * 80}}


def imap(kind, text):
    return {"imap": {f"imap.{kind}": text}}


GREETING = ("s", imap("response", "* OK [CAPABILITY IMAP4rev1 LOGIN-REFERRALS STARTTLS AUTH=PLAIN] ready"))
ASKS = ("c", imap("request", ". STARTTLS"))


def typed(spark, packets, capture="capture"):
    rows = [(capture, i, json.dumps(p)) for i, p in enumerate(packets, 1)]
    return posture.type_packets(flatten_packets(spark.createDataFrame(rows, "capture string, packet_no long, json string")))


def assess(spark, packets):
    return [r.asDict(True) for r in posture.scored_sessions(typed(spark, packets)).orderBy("first_frame").collect()]


def codes(session):
    return {f["code"] for f in session["findings"]}
