"""Column functions against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from sealcheck.functions import fields as fx, mailtext as mt, tls
from sealcheck.operators import ranks


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_integers(spark):
    values = ["12", "0x1F", "12.9", "1e3", " 7 ", "x", "", "-5", "0b11", "0o17", "nan", "010"]
    assert column(spark, values, fx.to_int) == [12, 31, 12, 1000, 7, None, None, -5, 3, 15, None, 10]


def test_versions(spark):
    values = ["0x0304", "772", "TLS 1.2", "TLSv1.1", "0x0301", "SSLv3", "0x0300", "0x9999", "", None]
    assert column(spark, values, tls.tls_version_name) == ["TLS 1.3", "TLS 1.3", "TLS 1.2", "TLS 1.1", "TLS 1.0", "SSLv3", "SSLv3", None, None, None]


def test_verdicts(spark):
    cases = [("220 ready", None, "positive"), ("454 no", None, "negative"), ("354 go", None, None), ("+OK", None, "positive"),
             ("-ERR x", None, "negative"), ("* OK [CAPABILITY STARTTLS]", None, None), ("a OK x", "a", "positive"), ("A ok x", "a", "positive"),
             ("b OK x", "a", None), ("a.b NO x", "a.b", "negative"), ("aXb NO x", "a.b", None), ("a BYE", "a", "negative"), ("  a BAD", None, "negative"),
             ("250-STARTTLS", None, "positive"), ("OKAY", None, None), ("a OKAY", "a", None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, line string, tag string")
    got = [r["v"] for r in rows.select("i", mt.upgrade_verdict(F.col("line"), F.col("tag")).alias("v")).orderBy("i").collect()]
    assert got == [c for _, _, c in cases]


def test_clear_auth_and_command(spark):
    assert column(spark, ["AUTH  PLAIN x", "AUTHENTICATE\nLOGIN", "AUTH CRAM-MD5", "XAUTH PLAIN"], lambda v: mt.clear_auth(v, F.lit("SMTP"))) == [True, True, False, False]
    assert column(spark, ["a LOGIN u", "LOGIN", "a authenticate plain", "USER x"], lambda v: mt.clear_auth(v, F.lit("IMAP"))) == [True, False, True, False]
    assert column(spark, ["USER x", "pass y", "RETR 1"], lambda v: mt.clear_auth(v, F.lit("POP3"))) == [True, True, False]
    assert column(spark, ["a1 STARTTLS", "STLS", "XSTARTTLS", "stls now"], mt.starttls_command) == [True, True, False, True]
    assert column(spark, ["a1 STARTTLS", "STLS", ". starttls"], mt.starttls_tag) == ["a1", None, "."]


def test_suites(spark):
    got = column(spark, ["0xc02f", "C02F", "0x0018", "0xabcd", "TLS_RSA_WITH_RC4_128_SHA", "TLS_AES_128_GCM_SHA256", "odd", "0x00ff", "0x1a1a", "0x1a2a"],
                 lambda v: F.struct(tls.cipher_profile(v)["display"], tls.cipher_profile(v)["key_exchange"], tls.cipher_profile(v)["forward_secrecy"],
                                    tls.cipher_profile(v)["strength"], tls.is_signalling(v)))
    assert [tuple(g) for g in got][:7] == [
        ("TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256 (0xc02f)", "ECDHE", True, 90, False),
        ("TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256 (0xc02f)", "ECDHE", True, 90, False),
        ("TLS_DH_anon_WITH_RC4_128_MD5 (0x0018)", "ANON", None, 0, False), ("0xabcd", None, None, 0, False),
        ("TLS_RSA_WITH_RC4_128_SHA", "RSA", False, 5, False), ("TLS_AES_128_GCM_SHA256", "TLS 1.3 ephemeral", True, 90, False), ("odd", None, None, 50, False)]
    assert [g[4] for g in got][7:] == [True, True, False]


def test_hosts(spark):
    cases = [(["*.lab.test"], None, "mail.lab.test", True), (["*.lab.test"], None, "lab.test", False), (["*.lab.test"], None, "a.b.lab.test", False),
             (["MAIL.lab.test."], "x", "mail.LAB.test", True), ([], "mail.lab.test", "mail.lab.test", True), (["a.test"], "mail.lab.test", "mail.lab.test", False),
             ([], None, "mail.lab.test", False), (["localhost"], None, "localhost", False), (["a.test"], None, None, None)]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, sans array<string>, cn string, sni string")
    got = rows.select("i", tls.hostname_match(F.col("sans"), F.col("cn"), F.col("sni")).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [c[3] for c in cases]


def test_percentiles_equal_numpy(spark):
    rng = random.Random(3)
    data = {"flat": [1.0] * 500, "ties": [float(rng.randint(0, 3)) for _ in range(777)], "smooth": [rng.gauss(0, 9) for _ in range(3001)], "one": [4.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    probabilities = [0.0, 0.01, 0.08, 0.5, 0.99, 1.0]
    for r in ranks.exact_percentiles(rows, "g", "v", probabilities).collect():
        assert abs(r["percentile"] - np.percentile(data[r["g"]], r["probability"] * 100)) < 1e-9, r


def test_shares_and_places(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("g"), F.md5(F.col("id").cast("string")).alias("d"), "id")
    got = ranks.lowest_share(rows, "g", "d", 0.8).filter("chosen").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"rare": 80, "often": 720}
    keyed = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (499 - F.col("id")).alias("o"))
    placed = ranks.place_in_group(keyed, ["k"], ["o"], F.floor(F.col("o") / 40), "place").collect()
    assert len(placed) == 500
    for key in (None, 1, 2):
        mine = sorted((r for r in placed if r["k"] == key), key=lambda r: r["o"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
