"""Dissector exports made from the packets view, in both key spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.views import PACE, START_US, packets_view
from sealcheck.sources.packets import flatten_packets


def view_with_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_view(spark, sf_dir).withColumn("ts_us", F.expr(
        f"{START_US} + CAST(FLOOR(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) "
        f"/ CAST({PACE} AS DOUBLE)) AS BIGINT)"))


LAYER = {"SMTP": "smtp", "IMAP": "imap", "POP3": "pop"}


def _export_json(alias: bool):
    """One packet as JSON text; ``alias`` spells keys with underscores."""
    def name(key: str) -> str:
        layer = key.split(".")[0]
        return f"{layer}_{key.replace('.', '_')}" if alias else key

    def struct(pairs: dict) -> Column:
        return F.struct(*[c.alias(name(k)) for k, c in pairs.items()])

    def text(column) -> Column:
        return F.col(column).cast("string") if isinstance(column, str) else column

    seconds = F.concat(F.expr("ts_us DIV 1000000"), F.lit("."), F.lpad(F.expr("CAST(ts_us % 1000000 AS STRING)"), 6, "0"))
    def port(side):
        as_hex = F.concat(F.lit("0x"), F.lower(F.hex(side)))
        return F.when(F.col("stream_id") % 3 == 0, as_hex).otherwise(text(side))
    hello = F.col("hs_type").isNotNull()
    kinds = F.when(F.col("n_certs") > 0, F.lit("2,11,12")).otherwise(text("hs_type"))
    def dialogue(protocol):
        said = F.when(F.col("spoken") == protocol, F.col("mail_text"))
        asked = F.col("src_port") > 30000
        return F.when(said.isNotNull(), struct({
            f"{LAYER[protocol]}.request": F.when(asked, said), f"{LAYER[protocol]}.response": F.when(~asked, said),
            f"{LAYER[protocol]}.data.fragment": F.lit("USER never read")}))
    certs = F.when(F.col("n_certs") >= 2, F.array(F.hex(F.repeat("leaf_text", 8)), F.hex(F.repeat("issuer_text", 8)))) \
             .when(F.col("n_certs") >= 1, F.array(F.hex(F.repeat("leaf_text", 8))))
    tls = F.when(F.col("is_tls"), struct({
        "tls.record.content_type": F.when(hello, F.lit("22")).otherwise("23"),
        "tls.handshake.type": F.when(hello, kinds),
        "tls.handshake.version": F.when(hello, F.col("legacy")),
        "tls.handshake.ciphersuites.length": F.when(hello, F.lit("8")),
        "tls.handshake.ciphersuite": F.split("suites", ","),
        "tls.handshake.extensions.supported_version": F.split("supported", ","),
        "tls.handshake.extensions.server_name_len": F.when(F.col("sni").isNotNull(), F.lit("13")),
        "tls.handshake.extensions.server_name": F.col("sni"),
        "tls.handshake.extensions.key_share.group": F.col("key_group"),
        "tls.handshake.certificates.length": F.when(F.col("n_certs") > 0, F.lit("120")),
        "tls.handshake.certificate": certs,
        "tls.alert_message.desc": F.when(F.col("alert"), F.when(F.col("failure"), F.lit("Handshake Failure")).otherwise("Close Notify")),
    }))
    layers = F.struct(
        struct({"frame.number": text("frame"), "frame.time_epoch": seconds, "frame.len": text("frame_len")}).alias("frame"),
        struct({"ip.src": text("src_ip"), "ip.dst": text("dst_ip")}).alias("ip"),
        struct({"tcp.stream": text("stream_id"), "tcp.srcport": port("src_port"), "tcp.dstport": port("dst_port"),
                "tcp.len": F.lit("20"),
                "tcp.analysis.retransmission": F.when(F.col("retransmission"), F.lit("1"))}).alias("tcp"),
        dialogue("SMTP").alias("smtp"), dialogue("IMAP").alias("imap"), dialogue("POP3").alias("pop"), tls.alias("tls"))
    return F.to_json(F.struct(F.struct(layers.alias("layers")).alias("_source")))


def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture, packet_no, json): odd streams in the underscore spelling."""
    view = view_with_time(spark, sf_dir)
    return view.select("capture", F.col("frame").alias("packet_no"),
                       F.when(F.col("stream_id") % 2 == 1, _export_json(True)).otherwise(_export_json(False)).alias("json"))


def dissected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PACKET_FIELDS_SCHEMA rows read back from the exported text."""
    return flatten_packets(export_documents(spark, sf_dir))
