"""Explicit schemas at the edges of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

FIELD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

# One row per dissected packet, fields in document order.
PACKET_FIELDS_SCHEMA = T.StructType([
    T.StructField("capture", T.StringType()),
    T.StructField("packet_no", T.LongType()),
    T.StructField("fields", T.ArrayType(FIELD)),
])

# One row per packet after the typed projection (plans.posture.type_packets).
PACKET_SCHEMA = T.StructType([
    T.StructField("capture", T.StringType()),
    T.StructField("packet_no", T.LongType()),
    T.StructField("stream_id", T.StringType()),
    T.StructField("frame", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("rel_s", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("frame_len", T.LongType()),
    T.StructField("retransmission", T.BooleanType()),
    T.StructField("layer_protocol", T.StringType()),
    T.StructField("has_mail_layer", T.BooleanType()),
    T.StructField("mail_text", T.StringType()),
    T.StructField("is_tls", T.BooleanType()),
    T.StructField("client_hello", T.BooleanType()),
    T.StructField("server_hello", T.BooleanType()),
    T.StructField("hs_types", T.ArrayType(T.StringType())),
    T.StructField("versions", T.ArrayType(T.StringType())),
    T.StructField("supported_version", T.StringType()),
    T.StructField("legacy_version", T.StringType()),
    T.StructField("ciphers", T.ArrayType(T.StringType())),
    T.StructField("sni", T.StringType()),
    T.StructField("server_name", T.StringType()),
    T.StructField("key_group", T.StringType()),
    T.StructField("cert_values", T.ArrayType(T.StringType())),
    T.StructField("alert", T.BooleanType()),
    T.StructField("failure", T.BooleanType()),
    T.StructField("payload_hex", T.StringType()),
])

# Certificate facts, one row per fingerprint.
CERTIFICATE_SCHEMA = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("issuer", T.StringType()),
    T.StructField("common_name", T.StringType()),
    T.StructField("sans", T.ArrayType(T.StringType())),
    T.StructField("serial", T.StringType()),
    T.StructField("valid_from_epoch", T.LongType()),
    T.StructField("valid_until_epoch", T.LongType()),
    T.StructField("key_algorithm", T.StringType()),
    T.StructField("key_bits", T.IntegerType()),
    T.StructField("curve", T.StringType()),
    T.StructField("sig_hash", T.StringType()),
])

EXPECTATION_SCHEMA = T.StructType([
    T.StructField("capture", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("server_port", T.IntegerType()),
    T.StructField("client_port", T.IntegerType()),
    T.StructField("mode", T.StringType()),
    T.StructField("profile", T.StringType()),
    T.StructField("seen_in_training", T.BooleanType()),
    T.StructField("rounds", T.IntegerType()),
    T.StructField("expect_findings", T.ArrayType(T.StringType())),
    T.StructField("forbid_findings", T.ArrayType(T.StringType())),
    T.StructField("class_exact", T.StringType()),
    T.StructField("class_band", T.ArrayType(T.StringType())),
    T.StructField("facts", T.StructType([
        T.StructField("checks_version", T.BooleanType()),
        T.StructField("tls_version", T.StringType()),
        T.StructField("checks_cert", T.BooleanType()),
        T.StructField("cert_observed", T.BooleanType()),
        T.StructField("checks_secrecy", T.BooleanType()),
        T.StructField("forward_secrecy", T.BooleanType()),
    ])),
])
