"""Packets and certificates derived from the driver's ``events`` table.

The two SELECT texts run unchanged on Spark and DuckDB; everything the queries read is
derived from them, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF_EPOCH = 1_700_000_000
START_US = 1_704_067_200_000_000
# The events of one user lie hours apart; two thirds of the streams are paced up so that
# short sessions, long ones and ones with implausible gaps all occur.
PACE = "CASE CAST(stream_id % 3 AS INT) WHEN 0 THEN 500 WHEN 1 THEN 5 ELSE 1 END"

PACKETS_SQL = """
WITH ev AS (
  SELECT event_id, user_id, ts, value, event_type,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn
  FROM {events}),
st AS (
  SELECT ev.*, CAST(FLOOR(rn / 7) AS INT) AS sess, CAST(rn % 7 AS INT) + 1 AS idx,
         user_id * 1000 + CAST(FLOOR(rn / 7) AS INT) AS stream_id
  FROM ev),
sc AS (
  SELECT st.*,
    CASE CAST(stream_id % 10 AS INT) WHEN 0 THEN 25 WHEN 1 THEN 587 WHEN 2 THEN 143 WHEN 3 THEN 110
      WHEN 4 THEN 465 WHEN 5 THEN 993 WHEN 6 THEN 995 WHEN 7 THEN 2525 WHEN 8 THEN 8143 ELSE 9993 END AS server_port,
    CAST(40000 + stream_id % 20000 AS INT) AS client_port,
    CAST((user_id + sess * 3) % 8 AS INT) AS scenario
  FROM st),
pk AS (
  SELECT sc.*,
    server_port IN (465, 993, 995, 9993) AS implicit,
    CASE WHEN server_port IN (465, 993, 995, 9993) THEN idx % 2 = 1 ELSE idx % 2 = 0 END AS from_client,
    CASE WHEN server_port IN (25, 587, 465, 2525) THEN 'SMTP'
         WHEN server_port IN (143, 993, 8143, 9993) THEN 'IMAP' ELSE 'POP3' END AS spoken
  FROM sc),
base AS (
SELECT 'cap-' || CAST(user_id % 20 AS STRING) AS capture, stream_id, idx, event_id AS frame, ts,
  CASE WHEN from_client THEN client_port ELSE server_port END AS src_port,
  CASE WHEN from_client THEN server_port ELSE client_port END AS dst_port,
  CASE WHEN from_client THEN '10.0.0.' || CAST(user_id % 200 AS STRING) ELSE '10.1.0.' || CAST(stream_id % 10 AS STRING) END AS src_ip,
  CASE WHEN from_client THEN '10.1.0.' || CAST(stream_id % 10 AS STRING) ELSE '10.0.0.' || CAST(user_id % 200 AS STRING) END AS dst_ip,
  CAST(60 + FLOOR(value) AS BIGINT) AS frame_len, event_type = 'error' AS retransmission, spoken, scenario, implicit,
  CASE WHEN implicit THEN NULL
    WHEN idx = 1 THEN CASE spoken WHEN 'SMTP' THEN '220 mail ESMTP 250-STARTTLS' WHEN 'IMAP' THEN '* OK [CAPABILITY IMAP4rev1 STARTTLS] ready' ELSE '+OK POP3 ready STLS' END
    WHEN idx = 2 AND scenario = 5 THEN CASE spoken WHEN 'SMTP' THEN 'AUTH PLAIN AGE=' WHEN 'IMAP' THEN 'a001 LOGIN u p' ELSE 'USER u' END
    WHEN idx = 2 AND scenario <> 6 THEN CASE spoken WHEN 'IMAP' THEN 'a001 STARTTLS' WHEN 'SMTP' THEN 'STARTTLS' ELSE 'STLS' END
    WHEN idx = 3 AND scenario = 4 THEN CASE spoken WHEN 'IMAP' THEN 'a001 NO refused' WHEN 'SMTP' THEN '454 refused' ELSE '-ERR refused' END
    WHEN idx = 3 AND scenario < 4 THEN CASE spoken WHEN 'IMAP' THEN 'a001 OK begin TLS' WHEN 'SMTP' THEN '220 ready' ELSE '+OK begin TLS' END
    END AS mail_text,
  CASE WHEN (implicit AND idx = 1) OR (NOT implicit AND idx = 4 AND scenario < 4) THEN 1
       WHEN (implicit AND idx = 2) OR (NOT implicit AND idx = 5 AND scenario < 4) THEN 2 END AS hs_type,
  CASE WHEN (implicit AND idx = 2) OR (NOT implicit AND idx = 5 AND scenario < 4)
       THEN CASE scenario WHEN 1 THEN 'TLS 1.0' WHEN 2 THEN 'TLS 1.1' WHEN 3 THEN 'TLS 1.3' ELSE 'TLS 1.2' END END AS server_version,
  CASE WHEN (implicit AND idx = 2) OR (NOT implicit AND idx = 5 AND scenario < 4)
       THEN CASE scenario WHEN 1 THEN '0x002f' WHEN 2 THEN '0xc013' WHEN 3 THEN '0x1302' WHEN 4 THEN '0x0002' WHEN 5 THEN '0x000a' WHEN 6 THEN '0xabcd' ELSE '0xc02f' END END AS server_cipher,
  (implicit OR (idx >= 4 AND scenario < 4)) AS is_tls
FROM pk)
SELECT base.*,
  CASE WHEN hs_type = 1 THEN CASE CAST(stream_id % 4 AS INT) WHEN 0 THEN '0xc02f,0x1302,0x00ff' WHEN 1 THEN '0x0a0a,0xc030,0x002f,0x000a'
       WHEN 2 THEN '0x1301,0x1302,0x1303,0xc02b,0xc02c,0xc02f,0xc030,0xcca8,0xcca9,0xc013' ELSE '0xabcd,TLS_RSA_WITH_AES_128_CBC_SHA' END
       WHEN hs_type = 2 THEN server_cipher END AS suites,
  CASE WHEN hs_type = 1 THEN CASE WHEN stream_id % 3 = 0 THEN '0x0304,0x0303' END
       WHEN hs_type = 2 AND server_version = 'TLS 1.3' THEN '0x0304' END AS supported,
  CASE WHEN hs_type = 1 THEN '0x0303'
       WHEN hs_type = 2 THEN CASE server_version WHEN 'TLS 1.0' THEN '0x0301' WHEN 'TLS 1.1' THEN '0x0302' ELSE '0x0303' END END AS legacy,
  CASE WHEN hs_type = 1 AND stream_id % 3 <> 1 THEN CASE WHEN stream_id % 7 = 0 THEN 'other.mail.test' ELSE 'mail.lab.test' END END AS sni,
  CASE WHEN hs_type = 2 AND stream_id % 2 = 0 THEN 'x25519' END AS key_group,
  (is_tls AND hs_type IS NULL AND retransmission AND stream_id % 3 = 0) AS alert,
  (is_tls AND hs_type IS NULL AND retransmission AND stream_id % 3 = 0 AND idx = 7) AS failure,
  CASE WHEN hs_type = 2 AND server_version <> 'TLS 1.3' THEN 1 + CASE WHEN stream_id % 5 = 0 OR stream_id % 5 = 2 THEN 1 ELSE 0 END ELSE 0 END AS n_certs,
  CASE WHEN stream_id % 17 = 3 THEN '0bad-' ELSE '0fp-' END || CAST(stream_id AS STRING) || '-0;' AS leaf_text,
  '0fp-' || CAST(stream_id AS STRING) || '-1;' AS issuer_text
FROM base
"""

CERTIFICATES_SQL = """
SELECT stream_id, pos,
  '0fp-' || CAST(stream_id AS STRING) || '-' || CAST(pos AS STRING) || ';' AS cert_text,
  'fp-' || CAST(stream_id AS STRING) || '-' || CAST(pos AS STRING) AS fingerprint,
  CASE WHEN pos = 0 THEN 'CN=mail.lab.test' ELSE 'CN=ca.lab.test' END AS subject,
  CASE WHEN pos = 0 AND stream_id % 5 = 1 THEN 'CN=mail.lab.test'
       WHEN pos = 0 AND stream_id % 5 = 2 THEN 'CN=other-ca.test'
       WHEN pos = 1 AND stream_id % 2 = 1 THEN 'CN=root.lab.test' ELSE 'CN=ca.lab.test' END AS issuer,
  CASE CAST(stream_id % 4 AS INT) WHEN 0 THEN '*.lab.test' WHEN 1 THEN 'MAIL.lab.test.' WHEN 2 THEN 'legacy.mail.test' END AS san,
  CASE WHEN stream_id % 6 = 0 THEN 'EC' ELSE 'RSA' END AS key_algorithm,
  CASE WHEN stream_id % 6 = 0 THEN 256 WHEN stream_id % 6 = 1 THEN 1024 ELSE 2048 END AS key_bits,
  CASE WHEN stream_id % 9 = 0 THEN 'sha1' ELSE 'sha256' END AS sig_hash,
  1700000000 - 86400 * 30 + CASE WHEN stream_id % 11 = 0 THEN 86400 * 40 ELSE 0 END AS valid_from_epoch,
  1700000000 + 86400 * (stream_id % 120 - 20) AS valid_until_epoch
FROM {certs}
WHERE pos = 0 OR stream_id % 5 = 0 OR stream_id % 5 = 2
"""

STREAMS_SQL = """
SELECT DISTINCT user_id * 1000 + CAST(FLOOR(rn / 7) AS INT) AS stream_id
FROM (SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM {events}) e
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PACKETS_SQL, events=table(spark, sf_dir, "events"))


def certificates_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = spark.sql(STREAMS_SQL, events=table(spark, sf_dir, "events"))
    return spark.sql(CERTIFICATES_SQL, certs=streams.select("stream_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")))


def certificate_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificates view keyed by the digest of the bytes the packets carry."""
    return certificates_view(spark, sf_dir).select(
        F.sha2(F.repeat("cert_text", 8), 256).alias("fingerprint"),
        "subject", "issuer", F.expr("substring(subject, 4)").alias("common_name"),
        F.array_compact(F.array("san")).alias("sans"),
        F.col("valid_from_epoch").cast("bigint").alias("valid_from_epoch"),
        F.col("valid_until_epoch").cast("bigint").alias("valid_until_epoch"),
        "key_algorithm", F.col("key_bits").cast("int").alias("key_bits"), "sig_hash")


def typed_packets(spark: SparkSession, sf_dir: str, hints: bool = True) -> DataFrame:
    """Packets in PACKET_SCHEMA.

    ``hints`` labels the dialogue on unusual ports too, as an export made with decode
    hints would; without them only standard ports carry a mail layer.
    """
    from sealcheck.functions import tls
    from sealcheck.functions.fields import port_protocol

    view = packets_view(spark, sf_dir)
    standard = F.coalesce(port_protocol(F.col("src_port")), port_protocol(F.col("dst_port"))).isNotNull()
    layer = F.when(F.col("mail_text").isNotNull() & (F.lit(hints) | standard), F.col("spoken"))
    codes = F.concat(F.coalesce(F.split("supported", ","), F.array().cast("array<string>")), F.array("legacy"))
    values = F.concat(
        F.when(F.col("n_certs") >= 1, F.array(F.hex(F.repeat("leaf_text", 8)))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("n_certs") >= 2, F.array(F.hex(F.repeat("issuer_text", 8)))).otherwise(F.array().cast("array<string>")))
    return view.select(
        "capture", F.col("frame").alias("packet_no"), F.col("stream_id").cast("string").alias("stream_id"), "frame",
        F.expr(f"""{START_US} + CAST(FLOOR(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)
                   / CAST({PACE} AS DOUBLE)) AS BIGINT)""").alias("ts_us"),
        F.lit(None).cast("double").alias("rel_s"), "src_ip", "dst_ip", "src_port", "dst_port", "frame_len",
        "retransmission", layer.alias("layer_protocol"), layer.isNotNull().alias("has_mail_layer"),
        F.when(layer.isNotNull(), F.col("mail_text")).alias("mail_text"), "is_tls",
        (F.col("hs_type") == 1).alias("client_hello"), (F.col("hs_type") == 2).alias("server_hello"),
        F.when(F.col("hs_type") == 1, F.array(F.lit("1")))
         .when(F.col("n_certs") > 0, F.array(F.lit("2"), F.lit("11")))
         .when(F.col("hs_type") == 2, F.array(F.lit("2"))).otherwise(F.array().cast("array<string>")).alias("hs_types"),
        F.array_compact(F.transform(codes, tls.tls_version_name)).alias("versions"),
        F.split("supported", ",")[0].alias("supported_version"), F.col("legacy").alias("legacy_version"),
        F.split("suites", ",").alias("ciphers"), "sni", F.col("sni").alias("server_name"), "key_group", values.alias("cert_values"),
        "alert", "failure", F.hex("mail_text").alias("payload_hex"))
