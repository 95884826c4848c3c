"""From typed packets to sessions, findings, scores and capture summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sealcheck.functions import fields as fx, tls
from sealcheck.operators import certificates, discovery, features, rules, scoring, sessions, triage
from sealcheck.session import materialise, staged


def type_packets(raw: DataFrame) -> DataFrame:
    """schemas.PACKET_FIELDS_SCHEMA to schemas.PACKET_SCHEMA."""
    f = F.col("fields")
    flags = raw.withColumn("flags", fx.tls_flags(f))
    return flags.select(
        "capture", "packet_no", fx.field_first(f, "tcp.stream").alias("stream_id"),
        fx.field_int(f, "frame.number").alias("frame"), fx.packet_time_us(f).alias("ts_us"),
        fx.relative_time(f).alias("rel_s"),
        fx.ip_value(f, "ip.src", "ipv6.src").alias("src_ip"), fx.ip_value(f, "ip.dst", "ipv6.dst").alias("dst_ip"),
        fx.field_int(f, "tcp.srcport", "udp.srcport").cast("int").alias("src_port"),
        fx.field_int(f, "tcp.dstport", "udp.dstport").cast("int").alias("dst_port"),
        fx.frame_length(f).alias("frame_len"), fx.is_retransmission(f).alias("retransmission"),
        fx.dissected_protocol(f).alias("layer_protocol"), fx.has_mail_layer(f).alias("has_mail_layer"),
        fx.mail_text(f).alias("mail_text"),
        F.col("flags.is_tls").alias("is_tls"), F.col("flags.client_hello").alias("client_hello"),
        F.col("flags.server_hello").alias("server_hello"), fx.handshake_types(f).alias("hs_types"),
        tls.handshake_versions(f).alias("versions"),
        F.trim(F.split(fx.field_first(f, "handshake.extensions.supported.version"), ",")[0]).alias("supported_version"),
        F.trim(F.split(fx.field_first(f, "handshake.version"), ",")[0]).alias("legacy_version"),
        tls.cipher_values(f).alias("ciphers"), fx.sni_value(f).alias("sni"),
        fx.server_name(f).alias("server_name"),
        fx.field_first(f, "key.share.group", "supported.groups", "named.group").alias("key_group"),
        fx.certificate_values(f).alias("cert_values"),
        F.col("flags.alert").alias("alert"), F.col("flags.failure").alias("failure"),
        fx.field_first(f, "tcp.payload").alias("payload_hex"))


def complete_sessions(packets: DataFrame, certs: DataFrame | None = None, as_of_epoch: int = 0,
                      discovered: DataFrame | None = None, **split) -> DataFrame:
    """Sessions with certificate facts and features."""
    folded = sessions.sessionise(packets, discovered, **split)
    chains = None
    if certs is not None:
        chains = certificates.chain_status(certificates.sent_certificates(packets), certs)
    attached = certificates.attach_certificates(folded, certs, chains, as_of_epoch)
    return features.session_features(attached)


def scored_sessions(packets: DataFrame, certs: DataFrame | None = None, as_of_epoch: int = 0, **options) -> DataFrame:
    """Sessions with findings, score, class and completeness."""
    return scoring.score_sessions(rules.assess_sessions(complete_sessions(packets, certs, as_of_epoch, **options)))


def two_pass_sessions(packets: DataFrame, **split) -> DataFrame:
    """Sessions on standard ports and on ports whose dialogue gave the protocol away."""
    found = staged(discovery.discovered_ports(packets), "ports")
    first = sessions.sessionise(discovery.mail_scope(packets), **split)
    extra = sessions.sessionise(discovery.dissect_discovered(packets, found), found, **split)
    return discovery.merge_passes(first, extra)


@dataclass(frozen=True)
class Analysis:
    """Scored sessions, encrypted streams without a session, and a record per capture."""
    sessions: DataFrame
    leftovers: DataFrame
    captures: DataFrame


def analyse(packets: DataFrame, certs: DataFrame | None = None, as_of_epoch: int = 0, captures: DataFrame | None = None,
            failures: DataFrame | None = None, predictions: DataFrame | None = None, fingerprint: str | None = None, **split) -> Analysis:
    """A whole analysis: mail scope, both passes, certificates, rules, scores, triage class, summaries and what was left over.

    ``captures`` (capture) also lists captures without a packet; ``failures`` (path, error) tells why text became none. Captures
    without sessions have zero counts, no class, and a state, a note on leftovers or an error instead.
    """
    merged = two_pass_sessions(packets, **split)
    chains = None if certs is None else certificates.chain_status(certificates.sent_certificates(packets), certs)
    attached = certificates.attach_certificates(merged, certs, chains, as_of_epoch)
    scored = scoring.score_sessions(rules.assess_sessions(features.session_features(attached)))
    scored = materialise(triage.rule_fallback(scored, predictions, fingerprint))     # summaries and leftovers read it again
    leftovers = discovery.unclassified_tls(packets, scored)

    listed = packets.select("capture").distinct()
    if captures is not None:
        listed = listed.union(captures.select("capture")).distinct()
    reasons = None
    if failures is not None:
        reasons = failures.groupBy(F.col("path").alias("capture")).agg(F.min("error").alias("reason"))
        listed = listed.union(reasons.select("capture")).distinct()
    state = discovery.capture_state(listed, packets, scored, leftovers).select("capture", "state", F.col("streams").alias("unclassified_streams"))
    notes = discovery.unclassified_note(leftovers).select("capture", F.col("note").alias("unclassified_note"))
    records = scoring.batch_record(scored)
    rows = state.join(records, "capture", "left").join(notes, "capture", "left")
    rows = rows.join(reasons, "capture", "left") if reasons is not None else rows.withColumn("reason", F.lit(None).cast("string"))
    counts = [c for c, kind in records.dtypes if kind == "bigint"]
    ok = F.col("state") != "UNREADABLE"
    rows = rows.na.fill(0, counts).withColumns({"ok": ok, "error": F.when(~ok, F.coalesce("reason", F.lit(""))).otherwise("")})
    return Analysis(scored, leftovers, rows.drop("reason"))
