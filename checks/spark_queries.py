"""One DataFrame per operator, on the driver's tables or tables derived from them.

Lists, maps and structs are flattened to text so that any engine can compare them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import exports, views
from sealcheck.functions import fields as fx, mailtext as mt, tls
from sealcheck.operators import (
    anomaly, certificates, discovery, evaluation, features, forest, reports, rules, scoring, sessions, triage,
)
from sealcheck.plans import posture
from sealcheck.session import materialise, staged, use_checkpoint_dir
from sealcheck.sources import captures, digests, packets, sinks
from sealcheck.tables import RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = views.AS_OF_EPOCH


def query(name: str):
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return keep


def text(column) -> Column:
    """Array to text."""
    return F.array_join(column, ";", "NULL")


def count() -> Column:
    return F.count(F.lit(1))


# ------------------------------------------------------------------ shared inputs
_PLANS: dict[tuple, DataFrame] = {}


def planned(function: Query) -> Query:
    """Keep the analysed plan (not the data) of a shared input, so it is built once per session."""
    def build(spark, sf, *options):
        key = (spark.sparkContext.applicationId, id(spark), function.__name__, sf, *options)
        if key not in _PLANS:
            _PLANS[key] = function(spark, sf, *options)
        return _PLANS[key]
    return build


@planned
def typed(spark, sf, hints=True):
    return views.typed_packets(spark, sf, hints)


@planned
def dissected(spark, sf):
    return exports.dissected(spark, sf)


@planned
def folded(spark, sf):
    return sessions.sessionise(typed(spark, sf))


@planned
def complete(spark, sf):
    certs = views.certificate_dimension(spark, sf)
    chains = certificates.chain_status(certificates.sent_certificates(typed(spark, sf)), certs)
    return features.session_features(certificates.attach_certificates(folded(spark, sf), certs, chains, AS_OF))


@planned
def scored(spark, sf):
    """Scored sessions; the triage class is the feature label, so that no fit is needed."""
    rows = scoring.score_sessions(rules.assess_sessions(complete(spark, sf)))
    return triage.feature_risk_label(rows).withColumnRenamed("feature_label", "ml_class").drop("label_score")


def kept(df: DataFrame, *columns) -> DataFrame:
    """Some columns of a shared input, computed once for a query that reads them several times."""
    return staged(df.select(*columns), "kept")


def scratch(spark, name: str) -> str:
    """A new path in the shared folder."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def session_columns(spark, sf, *columns):
    return folded(spark, sf).select("capture", "stream_id", *columns)


# ------------------------------------------------------------------ S: sources and sinks
def file_table(spark, sf):
    """Capture-like paths derived from the crawled pages."""
    ending = F.element_at(F.array(*map(F.lit, (".pcap", ".PCAPNG", ".cap", ".pcap.gz", ".txt", ".html"))),
                          (F.col("page_id") % 6 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("samples", "samples/lab", "samples/sweep", "data", "reports", "testset", "field"))),
                          (F.col("page_id") % 7 + 1).cast("int"))
    return views.table(spark, sf, "pages").select(
        F.concat(F.lit("/work/"), folder, F.lit("/cap-"), "page_id", ending).alias("path"), "page_id",
        F.length("html").cast("bigint").alias("length"))


@query("S1_capture_manifest")
def _(spark, sf):
    return captures.capture_manifest(file_table(spark, sf)).select("path", "length")


@query("S2_content_digest")
def _(spark, sf):
    return captures.with_sha256(views.table(spark, sf, "documents"), "text").select("doc_id", "sha256", "size_bytes")


@query("S3_packet_export_scan")
def _(spark, sf):
    path = scratch(spark, "export")
    text_rows = exports.export_documents(spark, sf).repartition("capture").sortWithinPartitions("capture", "packet_no")
    text_rows.select("capture", "json").write.partitionBy("capture").text(path)
    read = packets.read_packets(spark, path)
    pairs = F.transform("fields", lambda f: F.concat(f["key"], F.lit("="), f["value"]))
    return read.select(F.regexp_extract("capture", r"capture=([^/]+)/", 1).alias("capture"), "packet_no", F.size("fields").alias("n_fields"),
                       F.array_join(pairs, ";").alias("fields"))


@query("S4_field_subset_scan")
def _(spark, sf):
    path = scratch(spark, "fields")
    typed(spark, sf).filter("is_tls").select("packet_no", F.array_join("ciphers", ",").alias("ciphers")).write.option("sep", "\t").csv(path)
    return packets.read_packet_columns(spark, path, ["packet_no", "ciphers"], ("ciphers",)).select(
        "packet_no", F.explode("ciphers").alias("suite")).groupBy("suite").agg(count().alias("n"))


@query("S5_mail_scope")
def _(spark, sf):
    kept = discovery.mail_scope(typed(spark, sf, False), exclude_ports=(995,))
    return kept.groupBy("capture").agg(count().alias("packets"), F.sum("frame_len").alias("bytes"))


@query("S6_capture_records")
def _(spark, sf):
    path = scratch(spark, "records")
    sinks.write_captures(scoring.batch_record(scored(spark, sf)), path)
    back = spark.read.schema("capture string, total_sessions bigint, total_findings bigint, overall_risk_class string").json(path)
    return back.select("capture", F.to_json(F.struct("total_sessions", "total_findings", "overall_risk_class")).alias("record"))


@query("S7_capture_csv")
def _(spark, sf):
    return sinks.capture_csv(scoring.batch_record(scored(spark, sf)))


@query("S8_feature_table")
def _(spark, sf):
    return sinks.feature_table(scored(spark, sf))


@query("S9_split_failures")
def _(spark, sf):
    lines = views.table(spark, sf, "events").select(
        F.concat(F.lit("/work/"), "event_id").alias("path"),
        F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("broken "), "props")).otherwise(F.col("props")).alias("line"))
    parsed = lines.select("path", F.from_json("line", "k bigint, _corrupt_record string",
                                              {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good, bad = captures.split_failures(parsed.select("path", "r.*"))
    return good.select("path", "k", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("path", F.lit(None).cast("bigint").alias("k"), "error"))


@query("S10_resume_pending")
def _(spark, sf):
    done = file_table(spark, sf).select("path", (F.col("page_id") % 4 == 0).alias("ok")).filter(F.col("length") > 500)
    return captures.pending(captures.capture_manifest(file_table(spark, sf)), done).select("path")


def analyses(spark, sf):
    """Stored analyses derived from documents: several per file name and version."""
    return views.table(spark, sf, "documents").select(
        F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("analysis_id"),
        F.concat("source", F.lit("-"), (F.col("doc_id") % 17).cast("string"), F.lit(".pcapng")).alias("source_filename"),
        ((F.col("doc_id") * 7919) % 1000003).alias("created_at"),
        F.when(F.col("doc_id") % 5 == 0, "3.1.0").otherwise("3.2.0").alias("analyzer_version"),
        F.col("n_chars").alias("size_bytes"), F.col("text").alias("sessions"))


@query("S11_load_analysis")
def _(spark, sf):
    path = scratch(spark, "analyses")
    sinks.save_analysis(analyses(spark, sf), path)
    return sinks.load_analysis(spark, path, "a000000042").select("analysis_id", "source_filename", "size_bytes")


def released_files(spark, table):
    """A file per capture with a line per session, written and digested in ranges."""
    path = scratch(spark, "files")
    lines = table.select("capture", F.concat_ws(",", "session_id", "protocol", "risk_label").alias("line"))
    lines.repartition("capture").sortWithinPartitions("capture", "line").write.partitionBy("capture").text(path)
    named = F.regexp_extract("path", r"capture=([^/]+)/part-", 1)
    return digests.file_digests(spark, path).withColumn("capture", named).where("capture <> '' AND path NOT LIKE '%.crc'")


@query("S12_dataset_release")
def _(spark, sf):
    table = materialise(sinks.feature_table(scored(spark, sf)))
    shipped = table.select("capture").distinct().filter(F.col("capture").endswith("1") | F.col("capture").endswith("4"))
    parts = sinks.release(table, table.select("capture").distinct(), shipped, released_files(spark, table))
    totals = parts["totals"].select(F.explode(F.array(
        F.struct(F.lit("kept").alias("name"), F.col("kept").alias("n")),
        F.struct(F.lit("dropped").alias("name"), F.col("dropped").alias("n")))).alias("t")).select("t.*")
    counted = totals.unionByName(parts["labels"].select(F.concat(F.lit("label "), "risk_label").alias("name"), "n"))
    return counted.withColumn("sha256", F.lit(None).cast("string")).unionByName(
        parts["files"].select(F.concat(F.lit("file "), "capture").alias("name"), F.col("length").alias("n"), "sha256"))


# ------------------------------------------------------------------ T: look-ups
def lookup(name: str, columns):
    """A query over the field list; ``columns`` maps it to named look-ups."""
    @query(name)
    def _(spark, sf):
        found = columns(F.col("fields"))
        return dissected(spark, sf).select("packet_no", *[c.alias(n) for n, c in found.items()])


@query("T1_norm_key")
def _(spark, sf):
    raw = views.table(spark, sf, "events").select(F.concat_ws("_", F.upper("event_type"), F.lit("Frame.Len_X")).alias("raw"))
    return raw.groupBy("raw").agg(count().alias("n")).select("raw", fx.norm_key(F.col("raw")).alias("norm"), "n")


lookup("T2_field_values", lambda f: {
    "hits": F.size(fx.field_values(f, "smtp", "imap", "pop")),
    "suites": F.array_join(fx.field_values(f, "handshake.ciphersuite"), ","), "first": fx.field_first(f, "ip.dst")})
lookup("T3_field_int", lambda f: {
    "src_port": fx.field_int(f, "tcp.srcport"), "frame": fx.field_int(f, "frame.number"),
    "seconds": F.floor(fx.field_float(f, "frame.time.epoch"))})
lookup("T4_tls_version_name", lambda f: {
    "version": tls.tls_version_name(fx.field_first(f, "handshake.version")),
    "supported": tls.tls_version_name(fx.field_first(f, "supported.version"))})
lookup("T5_handshake_types", lambda f: {"types": F.array_join(F.array_sort(fx.handshake_types(f)), ",")})
lookup("T6_cipher_values", lambda f: {"suites": F.array_join(tls.cipher_values(f), ",")})
lookup("T7_packet_time", lambda f: {"ts_us": fx.packet_time_us(f), "relative": fx.relative_time(f)})
lookup("T8_mail_text", lambda f: {"said": fx.mail_text(f)})
lookup("T9_packet_protocol", lambda f: {"protocol": F.coalesce(fx.packet_protocol(
    f, fx.field_int(f, "tcp.srcport"), fx.field_int(f, "tcp.dstport")), F.lit("UNKNOWN"))})
lookup("T10_ip_value", lambda f: {
    "src_ip": fx.ip_value(f, "ip.src", "ipv6.src"), "hex_guard": fx.ip_value(f, "tcp.srcport")})
lookup("T11_sni_value", lambda f: {"sni": fx.sni_value(f)})
lookup("T12_certificate_values", lambda f: {
    "n": F.size(fx.certificate_values(f)),
    "last_length": F.length(F.try_element_at(fx.certificate_values(f), F.lit(-1)))})
lookup("T13_tls_flags", lambda f: {
    n: fx.tls_flags(f)[n] for n in ("is_tls", "client_hello", "server_hello", "alert", "failure")})
lookup("T14_frame_facts", lambda f: {
    "retransmission": fx.is_retransmission(f), "frame_len": fx.frame_length(f)})


def document_lines(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("T15_upgrade_verdict")
def _(spark, sf):
    said = typed(spark, sf).filter("mail_text is not null").select("packet_no", F.col("mail_text").alias("line"))
    line = F.col("line")
    verdicts = said.select("packet_no", mt.upgrade_verdict(line, F.lit(None).cast("string")).alias("untagged"),
                           mt.upgrade_verdict(line, F.lit("A001")).alias("tagged"))
    docs = document_lines(spark, sf).select(
        (-F.col("doc_id") * 100000 - F.col("pos") - 1).alias("packet_no"),
        mt.upgrade_verdict(line, F.lit(None).cast("string")).alias("untagged"), mt.upgrade_verdict(line, F.lit("A001")).alias("tagged"))
    return verdicts.unionByName(docs)


@query("T16_clear_auth")
def _(spark, sf):
    said = typed(spark, sf).filter("mail_text is not null").select("packet_no", "mail_text")
    docs = views.table(spark, sf, "documents").select((-F.col("doc_id") - 1).alias("packet_no"), F.col("text").alias("mail_text"))
    return said.unionByName(docs).select("packet_no", *[
        mt.clear_auth(F.col("mail_text"), F.lit(p)).alias(p.lower()) for p in ("SMTP", "IMAP", "POP3")])


@query("T17_starttls_command")
def _(spark, sf):
    said = typed(spark, sf).filter("mail_text is not null").select("packet_no", "mail_text")
    return said.select("packet_no", mt.starttls_command(F.col("mail_text")).alias("asks"),
                       mt.starttls_tag(F.col("mail_text")).alias("tag"),
                       mt.starttls_advertised(F.col("mail_text")).alias("mentions"))


# ------------------------------------------------------------------ D: unusual ports
def candidates(spark, sf):
    return discovery.payload_prefilter(typed(spark, sf, False))


@query("D1_payload_prefilter")
def _(spark, sf):
    return candidates(spark, sf).select("capture", "packet_no", "src_port", "text")


@query("D2_vocabulary_scores")
def _(spark, sf):
    s = mt.vocabulary_scores(F.col("text"))
    return views.table(spark, sf, "documents").select(
        "doc_id", *[s[i]["score"].alias(p) for i, p in enumerate(("smtp", "imap", "pop3"))])


@query("D3_port_votes")
def _(spark, sf):
    return discovery.port_votes(candidates(spark, sf))


@query("D4_first_greeting")
def _(spark, sf):
    return discovery.first_greeting(candidates(spark, sf))


@query("D5_port_hints")
def _(spark, sf):
    return discovery.port_hints(candidates(spark, sf))


@planned
def pairs(spark, sf):
    """Two neighbouring streams make a capture, so unusual ports also occur without standard ones."""
    return typed(spark, sf, False).withColumn("capture", F.concat(F.lit("s"), F.expr("CAST(stream_id AS BIGINT) DIV 2")))


@query("D6_discovered_ports")
def _(spark, sf):
    return discovery.discovered_ports(pairs(spark, sf))


@query("D7_merge_passes")
def _(spark, sf):
    return posture.two_pass_sessions(pairs(spark, sf)).select(
        "capture", "session_id", "protocol", "server_port", "client_port", "packet_count",
        "plaintext_auth", "starttls_rejected", "upgrade_successful")


@planned
def leftovers(spark, sf):
    raw = typed(spark, sf, False)
    return discovery.unclassified_tls(raw, sessions.sessionise(discovery.mail_scope(raw)))


@query("D8_unclassified_tls")
def _(spark, sf):
    return leftovers(spark, sf).drop("stream_no")


@query("D9_unclassified_note")
def _(spark, sf):
    return discovery.unclassified_note(leftovers(spark, sf))


@query("D9_stream_description")
def _(spark, sf):
    return leftovers(spark, sf).select("capture", "session_id", discovery.stream_description().alias("description"))


@query("D10_capture_state")
def _(spark, sf):
    raw = typed(spark, sf, False)
    # One capture per user here: some only hold encrypted leftovers, some nothing at all.
    each = raw.withColumn("capture", F.concat(F.lit("u"), F.expr("CAST(stream_id AS BIGINT) DIV 10")))
    listed = views.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.expr("(user_id * 1000 + event_id % 30) DIV 10")).alias("capture")).distinct()
    made = materialise(sessions.sessionise(discovery.mail_scope(each)).select("capture", "stream_id"))
    return discovery.capture_state(listed, each, made, discovery.unclassified_tls(each, made)).drop("packets")


# ------------------------------------------------------------------ A: sessions
@query("A1_packet_index")
def _(spark, sf):
    rows = sessions.ordered_rows(sessions.packet_events(typed(spark, sf)))
    return rows.select("capture", "stream_id", "packet_no", "packet_index")


@query("A2_endpoints")
def _(spark, sf):
    return session_columns(spark, sf, "client_ip", "client_port", "server_ip", "server_port")


@query("A3_direction")
def _(spark, sf):
    return sessions.ordered_rows(sessions.packet_events(typed(spark, sf))).select("packet_no", "from_client")


@query("A4_volume")
def _(spark, sf):
    return session_columns(spark, sf, "packet_count", "byte_count", "retransmission_count", "first_frame", "last_frame")


@query("A5_duration_ms")
def _(spark, sf):
    return session_columns(spark, sf, "duration_ms")


@query("A6_protocol_vote")
def _(spark, sf):
    return session_columns(spark, sf, "protocol", "protocol_confidence")


@query("A7_upgrade_success")
def _(spark, sf):
    return session_columns(spark, sf, "starttls_command", "upgrade_successful", "implicit_tls")


@query("A8_starttls_response")
def _(spark, sf):
    return session_columns(spark, sf, "answered_yes", "answered_no")


@query("A9_starttls_advertised")
def _(spark, sf):
    return session_columns(spark, sf, "starttls_advertised")


@query("A10_plaintext_auth")
def _(spark, sf):
    return session_columns(spark, sf, "plaintext_auth")


@query("A11_starttls_outcome")
def _(spark, sf):
    return session_columns(spark, sf, "starttls_accepted", "starttls_rejected", text("starttls_evidence").alias("evidence"))


@query("A12_tls_detected")
def _(spark, sf):
    return session_columns(spark, sf, "tls_detected", "implicit_tls")


@query("A13_negotiated_version")
def _(spark, sf):
    return session_columns(spark, sf, "tls_version", "version_source", text("offered_versions").alias("offered"))


@query("A14_negotiated_cipher")
def _(spark, sf):
    return session_columns(spark, sf, "cipher_suite", "cipher_source", "key_exchange", "forward_secrecy", "cipher_strength",
                           text("offered_ciphers").alias("offered"))


@query("A15_handshake_facts")
def _(spark, sf):
    return session_columns(spark, sf, "client_hello_seen", "server_hello_seen", "certificate_seen", "repeated_client_hellos",
                           "alert_seen", "handshake_failures", "sni", "named_group")


@query("A16_handshake_status")
def _(spark, sf):
    return session_columns(spark, sf, "handshake_status", "stream_status")


@query("A17_session_features")
def _(spark, sf):
    return complete(spark, sf).select("capture", "session_id", *features.feature_columns())


@query("A18_session_record")
def _(spark, sf):
    r = sessions.session_record(scored(spark, sf))
    return r.select("capture", "session_id", "tcp_stream_id", "protocol", F.unix_micros("start_time").alias("start_us"),
                    F.col("tls.tls_version").alias("tls_version"), F.col("tls.session_resumed").isNull().alias("resumed_unknown"),
                    F.col("starttls.accepted").alias("accepted"), F.col("certificate.subject").alias("subject"),
                    "policy_risk_score", "policy_risk_class")


# ------------------------------------------------------------------ C: ciphers and certificates
def suite_values(spark, sf):
    return typed(spark, sf).filter("is_tls").select(F.explode("ciphers").alias("value")).unionByName(
        views.table(spark, sf, "part").select(F.concat(F.lit("TLS_ECDHE_"), F.upper(F.translate("p_type", " #", "__")),
                                                       F.lit("_GCM_"), F.col("p_size").cast("string")).alias("value"))).distinct()


@query("C1_resolve_cipher")
def _(spark, sf):
    return suite_values(spark, sf).withColumn("p", tls.cipher_profile(F.col("value"))).select(
        "value", "p.code", "p.name", "p.display", "p.key_exchange", "p.forward_secrecy", "p.strength", "p.known")


@query("C2_signalling")
def _(spark, sf):
    code = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(F.col("l_partkey") * 26 % 65536), 4, "0")))
    return views.table(spark, sf, "lineitem").select(code.alias("code")).distinct() \
        .select("code", tls.is_signalling(F.col("code")).alias("signalling"))


def named_certificates(spark, sf):
    certs = views.certificates_view(spark, sf)
    return certs.withColumns({"sni": F.lit("mail.lab.test"), "sans": F.array_compact(F.array("san")),
                              "common_name": F.expr("substring(subject, 4)")})


@query("C3_certificate_validity")
def _(spark, sf):
    match = tls.hostname_match(F.col("sans"), F.col("common_name"), F.col("sni"))
    return certificates.validity_facts(named_certificates(spark, sf), AS_OF, match).select(
        "fingerprint", "expired", "not_yet_valid", "days_remaining", "self_signed", "weak_signature", "weak_key",
        "hostname_match", "status")


@query("C4_hostname_match")
def _(spark, sf):
    certs = named_certificates(spark, sf)
    return certs.select("fingerprint", *[
        tls.hostname_match(F.col("sans"), F.col("common_name"), F.lit(n)).alias(f"m{i}")
        for i, n in enumerate(("mail.lab.test", "LAB.test.", "a.mail.lab.test", "legacy.mail.test", "localhost"))],
        tls.hostname_match(F.col("sans"), F.col("common_name"), F.lit(None).cast("string")).alias("without_name"))


@query("C5_certificate_candidates")
def _(spark, sf):
    return certificates.sent_certificates(typed(spark, sf)).select("packet_no", F.col("slot").alias("pos"), "fingerprint")


@query("C6_attach_certificate")
def _(spark, sf):
    return complete(spark, sf).select("capture", "session_id", "cert_present", "cert_subject", "cert_key_bits", "cert_expired",
                                      "cert_hostname_match", "cert_chain_status", "cert_chain_length", "cert_status")


@query("C7_chain_status")
def _(spark, sf):
    return certificates.chain_status(certificates.sent_certificates(typed(spark, sf)), views.certificate_dimension(spark, sf)) \
        .select("stream_id", "chain_length", "chain_status", "chain_complete")


# ------------------------------------------------------------------ R: rules
def findings(spark, sf, codes=None):
    return rules.finding_rows(rules.assess_sessions(complete(spark, sf), codes))


@query("R0_assess_sessions")
def _(spark, sf):
    return findings(spark, sf).select("capture", "session_id", "code", "severity", "score_impact", "confidence", "title")


def _rule_query(position: int, code: str):
    @query(f"R{position}_{code.lower()}")
    def _(spark, sf):
        return findings(spark, sf, [code]).select(
            "capture", "session_id", "severity", "score_impact", text("evidence").alias("evidence"))


for _position, _rule in enumerate(RULES, 1):
    _rule_query(_position, _rule[0])


# ------------------------------------------------------------------ G: scoring
@query("G1_evidence_completeness")
def _(spark, sf):
    return scored(spark, sf).select("capture", "session_id", "evidence_completeness")


@query("G2_policy_score")
def _(spark, sf):
    return scored(spark, sf).select("capture", "session_id", "policy_risk_score", "posture_score")


@query("G3_risk_class")
def _(spark, sf):
    return scored(spark, sf).select("capture", "session_id", "policy_risk_class")


@query("G4_risk_band")
def _(spark, sf):
    return views.table(spark, sf, "events").select("event_id", scoring.risk_band(F.floor("value")).alias("band"))


@query("G5_flatten_findings")
def _(spark, sf):
    return scoring.flatten_findings(scored(spark, sf)).select("capture", "session_id", "emitted", "code", "severity_rank", "score_impact")


@query("G6_capture_summary")
def _(spark, sf):
    s = scoring.capture_summary(scored(spark, sf))
    maps = ("protocols", "tls_versions", "ciphers")
    return s.select(*[c for c in s.columns if c not in maps and c not in ("findings_by_severity", "ml_matches_rules")],
                    *[F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
                      .alias(m) for m in maps])


@query("G7_top_findings")
def _(spark, sf):
    return scoring.top_findings(scored(spark, sf))


@query("G8_recommendations")
def _(spark, sf):
    return scoring.recommendations(scored(spark, sf))


@query("G9_batch_record")
def _(spark, sf):
    b = scoring.batch_record(scored(spark, sf))
    return b.select("capture", "total_sessions", "total_findings", "overall_risk_score", "ml_matches_rules",
                    F.array_join(F.transform("top_findings", lambda t: t["code"]), ";").alias("top_codes"))


@query("G10_ml_rule_agreement")
def _(spark, sf):
    return scoring.ml_rule_agreement(scored(spark, sf))


@query("G11_feature_table_stats")
def _(spark, sf):
    return scoring.feature_table_stats(sinks.feature_table(scored(spark, sf)))


@query("G12_run_totals")
def _(spark, sf):
    return scoring.run_totals(scoring.capture_summary(scored(spark, sf)))


@query("G13_capture_check")
def _(spark, sf):
    return scoring.capture_check(scored(spark, sf))


# ------------------------------------------------------------------ M: triage
def with_paths(rows: DataFrame) -> DataFrame:
    """Capture files of the sessions: some in training folders, some held out."""
    number = F.substring("capture", 5, 4).cast("int")
    folder = F.element_at(F.array(*map(F.lit, ("samples", "samples/lab", "samples/sweep", "testset"))), number % 4 + 1)
    return rows.withColumn("path", F.concat(F.lit("/work/"), folder, F.lit("/"), "capture", F.lit(".pcapng")))


def training_of(rows: DataFrame) -> DataFrame:
    return triage.training_frame(triage.training_rows(with_paths(rows), "/work"), "policy_risk_class")


def training(spark, sf):
    """The first sessions of each capture are chosen among the folded ones; certificates and rules are for the chosen."""
    chosen = staged(triage.training_rows(with_paths(folded(spark, sf)), "/work"), "training")
    streams = chosen.select("capture", "stream_id").distinct()
    certs = views.certificate_dimension(spark, sf)
    sent = certificates.sent_certificates(typed(spark, sf)).join(streams, ["capture", "stream_id"], "left_semi")
    rows = certificates.attach_certificates(chosen, certs, certificates.chain_status(sent, certs), AS_OF)
    return triage.training_frame(scoring.score_sessions(rules.assess_sessions(features.session_features(rows))), "policy_risk_class")


@query("M1_feature_risk_label")
def _(spark, sf):
    return triage.feature_risk_label(complete(spark, sf)).select("capture", "session_id", "label_score", "feature_label")


@query("M2_training_rows")
def _(spark, sf):
    return triage.training_rows(with_paths(scored(spark, sf)), "/work").select("capture", "session_id", "copy_no")


@query("M3_stratified_split")
def _(spark, sf):
    return triage.stratified_split(scored(spark, sf), "policy_risk_class", ["capture", "session_id"]) \
        .select("capture", "session_id", "policy_risk_class", "is_train")


@query("M4_class_weights")
def _(spark, sf):
    return triage.class_weights(training(spark, sf), "label").select("label", F.bround("weight", 9).alias("weight")).distinct()


@query("M4_fit_risk")
def _(spark, sf):
    nodes = triage.fit_risk(training(spark, sf)).nodes
    leaf = F.col("kind") == "leaf"
    return nodes.groupBy("tree").agg(F.count_if(F.col("kind") == "split").alias("splits"), F.count_if(leaf).alias("leaves"), F.max("depth").alias("depth"),
                                     F.sum(F.when(leaf, F.col("rows"))).alias("rows"), F.sum(F.when(leaf, F.col("v0"))).alias("critical_votes"))


@query("M5_score_risk")
def _(spark, sf):
    rows = kept(scored(spark, sf), "capture", "session_id", "first_frame", "policy_risk_class", *features.feature_columns())
    model = triage.fit_risk(training_of(rows))
    return triage.score_risk(rows, model).select("capture", "session_id", "ml_class", "ml_confidence")


@query("M6_fit_anomaly")
def _(spark, sf):
    low = scored(spark, sf).filter(F.col("policy_risk_class") == "LOW")
    model = anomaly.fit_anomaly(low, ["capture", "session_id"])
    sizes = [(i, int(len(t[0])), int((t[0] < 0).sum())) for i, t in enumerate(model.trees)]
    return spark.createDataFrame(sizes, "tree int, nodes int, leaves int")


@query("M7_score_anomaly")
def _(spark, sf):
    rows = kept(scored(spark, sf), "capture", "session_id", "policy_risk_class", *features.feature_columns())
    model = anomaly.fit_anomaly(rows.filter(F.col("policy_risk_class") == "LOW"), ["capture", "session_id"])
    return anomaly.score_anomaly(rows, model).select("capture", "session_id", "ml_anomalous", "ml_anomaly_score")


@query("M8_rule_fallback")
def _(spark, sf):
    rows = kept(scored(spark, sf), "capture", "session_id", "server_port", "policy_risk_class", "ml_class")
    guess = rows.filter(F.col("server_port") != 25).select("capture", "session_id", "ml_class")
    return triage.rule_fallback(rows.drop("ml_class"), guess, triage.schema_fingerprint()) \
        .select("capture", "session_id", "ml_class", "ml_version", "ml_note")


@query("M9_explanations")
def _(spark, sf):
    return triage.explanations(scored(spark, sf)).select("capture", "session_id", text("ml_explanation").alias("titles"))


@query("M10_confusion")
def _(spark, sf):
    return triage.confusion(scored(spark, sf)).select("policy_risk_class", *[F.col(c) for c in triage.CLASSES])


@query("M10_agreement")
def _(spark, sf):
    return triage.agreement(scored(spark, sf), "capture")


@query("M11_leave_one_capture_out")
def _(spark, sf):
    return triage.leave_one_capture_out(training(spark, sf))


@query("M11_held_out_forests")
def _(spark, sf):
    nodes = forest.grow(training(spark, sf), "label", 120, folds=True).nodes
    leaf = F.col("kind") == "leaf"
    return nodes.groupBy(F.col("fold").alias("capture")).agg(F.countDistinct("tree").alias("trees"), F.count_if(leaf).alias("leaves"),
                                                             F.sum(F.when(leaf, F.col("rows"))).alias("rows"))


@query("M12_transfer_test")
def _(spark, sf):
    rows = staged(triage.training_frame(scored(spark, sf), "policy_risk_class"), "frame")
    odd = F.substring("capture", 5, 4).cast("int") % 2 == 1
    return triage.transfer_test(rows.filter(odd), rows.filter(~odd))


@query("M13_feature_ranges")
def _(spark, sf):
    ranges = triage.feature_ranges(complete(spark, sf))
    return ranges.select("feature", *[F.bround(c, 6).alias(c) for c in ("min", "p01", "p50", "p99", "max")])


def novelty(spark, sf):
    rows = kept(complete(spark, sf), "capture", "session_id", "first_frame", "server_port", *features.feature_columns())
    base = rows.filter(F.col("server_port").isin(25, 465, 587))
    return triage.novelty_session(rows, triage.collect_ranges(triage.feature_ranges(base)))


@query("M14_novelty_session")
def _(spark, sf):
    return novelty(spark, sf).select("capture", "session_id", text("outside_features").alias("outside"), "novel", "novelty_verdict", "novelty_note")


@query("M15_novelty_capture")
def _(spark, sf):
    return triage.novelty_capture(novelty(spark, sf)).withColumn("outside_features", text("outside_features"))


@query("M16_model_freshness")
def _(spark, sf):
    files = file_table(spark, sf).select("path", (F.col("length") + 1_700_000_000).alias("modified_epoch"), "page_id")
    return triage.model_freshness(files, F.lit(1_700_000_900).cast("bigint"), "/work").select("newest", "model_epoch", "fresh")


# ------------------------------------------------------------------ E: expectations
@planned
def declared(spark, sf):
    """A declaration per session, made from its port and scenario only."""
    view = views.packets_view(spark, sf).groupBy("capture", "stream_id").agg(
        F.first("spoken").alias("protocol"), F.first("scenario").alias("scenario"), F.bool_or("implicit").alias("implicit"),
        F.min(F.when(F.col("src_port") < 30000, F.col("src_port")).otherwise(F.col("dst_port"))).alias("server_port"),
        F.min(F.when(F.col("src_port") >= 30000, F.col("src_port")).otherwise(F.col("dst_port"))).alias("client_port"))
    s, p = F.col("scenario"), F.col("protocol")
    upgrade = F.when(p == "SMTP", "smtp_secure").when(p == "IMAP", "imap_starttls").otherwise("pop3_stls")
    refused = F.when(p == "SMTP", "smtp_reject_starttls").when(p == "IMAP", "imap_reject_starttls").otherwise("pop3_reject_stls")
    clear = F.when(p == "SMTP", "smtp_no_starttls").when(p == "IMAP", "imap_cleartext_login").otherwise("pop3_cleartext")
    mode = F.when(F.col("implicit"), "implicit_tls").when(s < 4, upgrade).when(s == 4, refused).otherwise(clear)
    profile = F.when(s == 1, "legacy-tls10").when(s == 2, "cbc-only").when(s == 3, "modern-tls13") \
               .when((s == 4) & F.col("implicit"), "null-cipher").when((s == 5) & F.col("implicit"), "static-rsa") \
               .when(F.col("implicit") | (s < 4), F.when(F.col("stream_id") % 6 == 1, "weak-cert").otherwise("modern"))
    return view.select("capture", F.when(F.col("stream_id") % 5 == 0, "large").otherwise("singles").alias("group"),
                       "protocol", "server_port", "client_port", mode.alias("mode"), profile.alias("profile"),
                       (F.col("stream_id") % 4 == 0).alias("seen_in_training"),
                       F.when(F.col("stream_id") % 50 == 7, 2).otherwise(1).alias("rounds"), F.col("stream_id").alias("entry_no"))


def expectation(spark, sf):
    return evaluation.declare_expectation(declared(spark, sf))


def matched_sides(spark, sf):
    """Expected and actual sessions, each computed once: places are counted in one reading and given in another."""
    codes = F.transform("findings", lambda f: F.struct(f["code"].alias("code"))).alias("findings")
    actual = kept(scored(spark, sf), *evaluation.PAIR, "session_id", "first_frame", "tls_detected", "tls_version", "cipher_suite", "forward_secrecy",
                  "cert_present", "policy_risk_class", "ml_class", codes)
    return kept(expectation(spark, sf), "*"), actual


def expected_rows(spark, sf):
    return evaluation.score_expectations(*matched_sides(spark, sf))


_SITUATION = ("capture", "protocol", "server_port", "client_port", "mode", "profile", "round")


@query("E1_match_expected")
def _(spark, sf):
    return evaluation.match_expected(*matched_sides(spark, sf)).select(
        *_SITUATION, F.col("actual.session_id").alias("session_id"))


@query("E2_check_findings")
def _(spark, sf):
    return expected_rows(spark, sf).filter("ok_matched").select(
        *_SITUATION, text("missing_findings").alias("missing"), text("violations").alias("violations"))


@query("E3_check_facts")
def _(spark, sf):
    return expected_rows(spark, sf).filter("ok_matched").select(*_SITUATION, "version_ok", "cert_ok", "secrecy_ok")


@query("E4_check_class")
def _(spark, sf):
    return expected_rows(spark, sf).filter("ok_matched").select(*_SITUATION, "class_ok")


@query("E5_score_summary")
def _(spark, sf):
    return evaluation.score_summary(expected_rows(spark, sf))


@query("E6_per_capture_checks")
def _(spark, sf):
    return evaluation.per_capture_checks(expected_rows(spark, sf))


@query("E7_observed_per_situation")
def _(spark, sf):
    return evaluation.observed_per_situation(expected_rows(spark, sf)).select(
        "protocol", "server_port", "mode", "profile", "seen", "rules_class", "findings")


@query("E8_ml_disagreements")
def _(spark, sf):
    return evaluation.ml_disagreements(expected_rows(spark, sf))


@query("E9_failed_expectations")
def _(spark, sf):
    return evaluation.failed_expectations(expected_rows(spark, sf))


def capture_files(spark, sf):
    """One file per capture, named after a scenario and a port it was moved to."""
    n = F.substring("capture", 5, 4).cast("int")
    names = F.array(*map(F.lit, ("imaps-cbc", "smtp-clear", "pop3-modern", "mixed")))
    return typed(spark, sf).select("capture").distinct().select(
        "capture", F.concat(F.element_at(names, n % 4 + 1), F.when(n % 3 == 0, F.concat(F.lit("-port"), 9000 + n)).otherwise(""),
                            F.lit(".pcapng")).alias("file"))


def scenarios(spark, sf):
    """Base scenarios, their wanted and forbidden codes taken from the rules table by name."""
    rows = [("imaps-cbc", ["LEGACY_CBC_CIPHER"], ["TLS_VERSION_UNKNOWN"]),
            ("smtp-clear", ["PLAINTEXT_AUTHENTICATION", "TLS_VERSION_UNKNOWN"], []),
            ("pop3-modern", [], ["INSECURE_CIPHER"])]
    return spark.createDataFrame(rows, "scenario string, expect_findings array<string>, forbid_findings array<string>")


@query("E10_capability_verdict")
def _(spark, sf):
    rows = evaluation.capability_verdict(capture_files(spark, sf), scenarios(spark, sf), scored(spark, sf), leftovers(spark, sf))
    return rows.select("capture", "scenario", "port", "sessions", "rules_class", "agree", text("missing").alias("missing"),
                       text("forbidden_seen").alias("forbidden_seen"), "verdict")


@query("E11_finding_coverage")
def _(spark, sf):
    return evaluation.finding_coverage(scored(spark, sf))


@query("E12_scenario_verify")
def _(spark, sf):
    named = capture_files(spark, sf).select("capture", evaluation.split_variant(F.col("file"))["scenario"].alias("scenario"))
    rows = evaluation.scenario_verify(named, scenarios(spark, sf), scored(spark, sf))
    return rows.select("capture", "scenario", "sessions", text("missing").alias("missing"), "worst_class", "posture", "status")


@query("E13_declare_expectation")
def _(spark, sf):
    rows = expectation(spark, sf)
    return rows.groupBy("protocol", "server_port", "mode", "profile", text("expect_findings").alias("expect"),
                        text("forbid_findings").alias("forbid"), "class_exact", text("class_band").alias("band"),
                        F.col("facts.tls_version").alias("tls_version"), F.col("facts.cert_observed").alias("cert_observed"),
                        F.col("facts.forward_secrecy").alias("forward_secrecy")).agg(count().alias("n"))


@query("E14_coverage_matrix")
def _(spark, sf):
    return evaluation.coverage_matrix(spark, declared(spark, sf)).select(
        "name", "port", "profile", text("expect_findings").alias("expect"), text("forbid_findings").alias("forbid"), "observed")


@query("E15_heldout_leak_check")
def _(spark, sf):
    paths = with_paths(typed(spark, sf).select("capture").distinct())
    train, held = paths.filter(triage.is_training_path(F.col("path"), "/work")), paths.filter(F.col("path").contains("/testset/"))
    leaks = evaluation.heldout_leaks(train, held).agg(count().alias("leaks"))
    bare = evaluation.undeclared_sessions(expectation(spark, sf)).agg(count().alias("undeclared"))
    return leaks.select(F.lit("leaks").alias("name"), F.col("leaks").alias("n")).unionByName(
        bare.select(F.lit("undeclared").alias("name"), F.col("undeclared").alias("n"))).unionByName(
        train.agg(count().alias("n")).select(F.lit("training").alias("name"), "n"))


@query("E16_replicate_shift")
def _(spark, sf):
    return evaluation.replicate_shift(typed(spark, sf), 3, 900).select("packet_no", "copy_no", "stream_id", "ts_us")


# ------------------------------------------------------------------ Q: reports
@query("Q1_list_analyses")
def _(spark, sf):
    return reports.list_analyses(analyses(spark, sf), summary_only=True)


@query("Q2_get_session")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("analysis_id", F.col("capture"))
    return reports.get_session(rows, "cap-3", "tcp.stream.3001").select("capture", "session_id", "policy_risk_score")


@query("Q3_current_version_only")
def _(spark, sf):
    return reports.current_version_only(analyses(spark, sf), "3.2.0").select("analysis_id", "created_at")


@query("Q4_newest_per_capture")
def _(spark, sf):
    return reports.newest_per_capture(analyses(spark, sf), "3.2.0", match="SRC1").select("source_filename", "analysis_id", "created_at")


@query("Q5_retention")
def _(spark, sf):
    return reports.total_size(reports.retention(analyses(spark, sf), "3.2.0", keep=20)).unionByName(
        reports.total_size(reports.retention(analyses(spark, sf), "3.2.0", stale_only=True)))


@query("Q6_ranked_sessions")
def _(spark, sf):
    return reports.ranked_sessions(scored(spark, sf)).select("capture", "session_id", "policy_risk_score", "total", "not_shown")


@query("Q7_top_findings_report")
def _(spark, sf):
    return reports.top_findings_report(scoring.flatten_findings(scored(spark, sf))).select("capture", "session_id", "code", "total")


@query("Q8_search")
def _(spark, sf):
    rows = scored(spark, sf)
    found = reports.search_findings(rules.finding_rows(rows), "stArttls").select("capture", "session_id", "code")
    return found.unionByName(reports.search_sessions(rows, "gcm").select("capture", "session_id", F.lit("(session)").alias("code")))


@query("Q9_severity_distribution")
def _(spark, sf):
    return reports.severity_distribution(rules.finding_rows(scored(spark, sf)))


@query("Q10_capture_facts")
def _(spark, sf):
    return reports.capture_facts(scoring.capture_summary(scored(spark, sf)))


@query("Q11_upgrade_label")
def _(spark, sf):
    return folded(spark, sf).select("capture", "session_id", reports.upgrade_label().alias("label"),
                                    reports.manifest_upgrade_label().alias("manifest_label"))


@query("Q12_sample_manifest")
def _(spark, sf):
    return reports.sample_manifest(scored(spark, sf))


@query("Q12_manifest_sessions")
def _(spark, sf):
    return reports.manifest_sessions(scored(spark, sf))


@query("Q13_ml_disagreement_flag")
def _(spark, sf):
    return reports.ml_disagreement_flag(scored(spark, sf))


# ------------------------------------------------------------------ P: a whole analysis
@query("P1_analyse")
def _(spark, sf):
    """Per capture, from packets whose unusual ports carry no hint."""
    certs = views.certificate_dimension(spark, sf)
    rows = posture.analyse(typed(spark, sf, False), certs, AS_OF).captures
    return rows.select("capture", "state", "ok", "total_sessions", "total_findings", "overall_risk_class", "unclassified_streams", "unclassified_note")
