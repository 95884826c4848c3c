"""Sessionisation: the ordered fold of packets into one row per TCP stream.

All text work happens per packet, before the shuffle, and leaves small flags. The fold
itself is one shuffle on (capture, stream): windows that share one sort order give the
position dependent facts, everything else is a mergeable aggregate.

A stream with more than ``SPLIT_ABOVE`` packets is cut into runs of ``RUN_PACKETS``
packets which are folded in parallel. What a run needs from earlier ones (endpoints,
direction hint, last time, last tag, offers so far) is summarised per run and carried
over; the four packets before each run are copied into it so that an upgrade command
and its answer may lie on either side of the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sealcheck.functions import fields as fx, mailtext as mt, tls
from sealcheck.operators.discovery import name_of, with_port_names
from sealcheck.session import materialise, staged
from sealcheck.tables import (
    EVIDENCE, IMPLICIT_TLS_PORTS, LONGEST_GAP_S, LONGEST_SESSION_S, RESPONSE_REACH,
)

KEY = ["capture", "stream_id"]
SPLIT_ABOVE = 4_000_000
RUN_PACKETS = 1_000_000
OFFERS_KEPT = 8
PROTOCOLS = ("SMTP", "IMAP", "POP3")


# --------------------------------------------------------------------- per packet
def packet_events(packets: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Narrow per-packet rows: every regular expression is evaluated here, once.

    ``discovered`` (capture, port, protocol) widens the known ports of a capture.
    """
    df = packets.withColumns({"src_proto": fx.port_protocol(F.col("src_port")),
                              "dst_proto": fx.port_protocol(F.col("dst_port"))})
    if discovered is not None:
        if "ports" not in df.columns:       # the second pass has met them already
            df = with_port_names(df, discovered)
        df = df.withColumns({f"{side}_proto": F.coalesce(f"{side}_proto", name_of(f"{side}_port")) for side in ("src", "dst")})
    text = F.col("mail_text")
    tls_packet = F.coalesce("is_tls", F.lit(False))
    hello_c = tls_packet & F.coalesce("client_hello", F.lit(False))
    hello_s = tls_packet & F.coalesce("server_hello", F.lit(False))
    suites = F.filter(F.coalesce("ciphers", F.array().cast("array<string>")), lambda c: ~tls.is_signalling(c))
    return df.select(
        "capture",
        F.coalesce("stream_id", F.concat(F.lit("unknown-"), F.col("packet_no"))).alias("stream_id"),
        "packet_no", "frame", "ts_us", "rel_s", "src_ip", "dst_ip", "src_port", "dst_port",
        F.greatest(F.coalesce("frame_len", F.lit(0)), F.lit(0)).alias("bytes"),
        F.coalesce("retransmission", F.lit(False)).alias("retransmission"),
        "src_proto", "dst_proto",
        F.when(F.col("dst_proto").isNotNull(), F.col("dst_port"))
         .when(F.col("src_proto").isNotNull(), F.col("src_port")).alias("known_port"),
        F.col("layer_protocol").alias("layer"),
        text.isNotNull().alias("has_text"),
        mt.starttls_command(text).alias("asks_upgrade"),
        mt.starttls_tag(text).alias("tag_seen"),
        mt.starttls_advertised(text).alias("offers_upgrade"),
        mt.clear_auth(text, F.lit("SMTP")).alias("auth_smtp"),
        mt.clear_auth(text, F.lit("IMAP")).alias("auth_imap"),
        mt.clear_auth(text, F.lit("POP3")).alias("auth_pop3"),
        mt.first_untagged_verdict(text).alias("plain_verdict"),
        mt.tagged_answers(text).alias("answers"),
        tls_packet.alias("is_tls"), hello_c.alias("client_hello"), hello_s.alias("server_hello"),
        F.when(tls_packet, tls.version_mask(F.col("versions"))).otherwise(0).alias("version_mask"),
        F.when(hello_s, F.try_element_at(suites, F.lit(-1))).alias("chosen_suite"),
        F.when(tls_packet & (hello_c | ~hello_s), suites)
         .otherwise(F.array().cast("array<string>")).alias("offers"),
        F.when(tls_packet, F.col("sni")).alias("sni"),
        F.when(tls_packet & (F.col("key_group") != ""), F.col("key_group")).alias("key_group"),
        F.coalesce(tls_packet & (F.size("cert_values") > 0), F.lit(False)).alias("certificate"),
        F.when(tls_packet, F.try_element_at(tls.certificate_candidates(F.col("cert_values")), F.lit(1)))
         .alias("leaf"),
        (tls_packet & F.coalesce("alert", F.lit(False))).alias("alert"),
        (tls_packet & F.coalesce("failure", F.lit(False))).alias("failure"),
    )


# ----------------------------------------------------------------- long streams
def long_streams(packets: DataFrame, split_above: int) -> DataFrame | None:
    """Streams to be cut, None without any. At most packets / split_above rows, hence small.

    The check counts two columns per stream; packets without a stream are streams of their own.
    """
    found = (packets.filter(F.col("stream_id").isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > split_above).select(KEY))
    found = staged(found, "long")
    return None if found.isEmpty() else found


def _origin() -> Column:
    """Who opened the stream: first packet that carries an address."""
    return F.struct(
        F.col("src_port").alias("port"),
        F.coalesce("src_proto", "dst_proto").alias("proto"),
    )


def _direction(rows: DataFrame) -> DataFrame:
    """Which packets come from the client, and what they ask for."""
    src, dst, hint = F.col("src_port"), F.col("dst_port"), F.col("hint")
    client = (F.when(src == hint, False).when(dst == hint, True)
              .when(F.col("origin.port").isNotNull(), F.coalesce(src == F.col("origin.port"), F.lit(False)))
              .otherwise(True))
    proto = F.when(F.col("origin").isNotNull(), F.col("origin.proto")) \
             .otherwise(F.coalesce("src_proto", "dst_proto"))
    asks = F.col("from_client") & F.col("asks_upgrade")
    auth = (F.when(F.col("port_proto") == "SMTP", F.col("auth_smtp"))
            .when(F.col("port_proto") == "IMAP", F.col("auth_imap"))
            .when(F.col("port_proto") == "POP3", F.col("auth_pop3")))
    return rows.select(
        "*", client.alias("from_client"), proto.alias("port_proto"), asks.alias("asks"),
        F.when(F.col("asks") & (F.col("port_proto") == "IMAP"), F.col("tag_seen")).alias("tag"),
        F.coalesce(F.col("from_client") & auth, F.lit(False)).alias("auth"))


def indexed_runs(events: DataFrame, cut: DataFrame, run_packets: int) -> DataFrame:
    """Packets of long streams with their stream-wide index, cut into runs with carry-in."""
    cut = F.broadcast(cut)     # bounded: packets / split_above rows
    rows = events.join(cut, KEY, "inner")
    heads = F.broadcast(rows.groupBy(KEY).agg(     # one row per cut stream
        F.min_by(_origin(), F.when(F.col("src_ip").isNotNull(), F.col("packet_no"))).alias("origin"),
        F.min_by("known_port", F.when(F.col("known_port").isNotNull(), F.col("packet_no"))).alias("hint"),
    ))
    rows = rows.withColumn("span", F.floor(F.col("packet_no") / run_packets))
    earlier = W.partitionBy(KEY).orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(KEY + ["span"]).agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.select(*KEY, "span", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    in_span = W.partitionBy(KEY + ["span"]).orderBy("packet_no")
    rows = (rows.join(offsets, KEY + ["span"], "inner")
            .withColumn("packet_index", F.col("offset") + F.row_number().over(in_span))
            .drop("span", "offset"))
    rows = _direction(rows.join(heads, KEY, "inner"))
    rows = rows.withColumn("run", F.floor((F.col("packet_index") - 1) / run_packets))

    before = W.partitionBy(KEY).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(KEY + ["run"]).agg(
        F.max_by("ts_us", F.when(F.col("ts_us").isNotNull(), F.col("packet_no"))).alias("ts"),
        F.max_by("tag", F.when(F.col("tag").isNotNull(), F.col("packet_no"))).alias("tag"),
        F.sum(F.size("offers")).alias("offers"),
    ).select(
        *KEY, "run",
        F.last("ts", ignorenulls=True).over(before).alias("carried_ts"),
        F.last("tag", ignorenulls=True).over(before).alias("carried_tag"),
        F.coalesce(F.sum("offers").over(before), F.lit(0)).alias("carried_offers"),
    )
    near_cut = (F.col("packet_index") - 1) % run_packets >= run_packets - RESPONSE_REACH
    copies = F.when(near_cut, F.array(F.col("run"), F.col("run") + 1)).otherwise(F.array("run"))
    return (rows.withColumn("in_run", F.explode(copies))
            .withColumn("copy", F.col("in_run") != F.col("run")).drop("run")
            .withColumnRenamed("in_run", "run")
            .join(carried, KEY + ["run"], "inner"))


# ------------------------------------------------------------------- the windows
def ordered_rows(events: DataFrame, cut: DataFrame | None = None, run_packets: int = RUN_PACKETS) -> DataFrame:
    """Events with packet_index, direction, gap to the previous packet and upgrade answers.

    ``cut`` names the streams to be folded in runs, see ``long_streams``.
    """
    if cut is None:
        return _position_facts(_indexed_whole(events), KEY)
    whole, runs = _whole_and_runs(events, cut, run_packets)
    return whole.withColumn("run", F.lit(0).cast("bigint")).unionByName(runs)


def _whole_and_runs(events: DataFrame, cut: DataFrame, run_packets: int) -> tuple[DataFrame, DataFrame]:
    """Position facts of ordinary streams and of the runs of cut ones; the streams are different ones."""
    ordinary = events.join(F.broadcast(cut), KEY, "left_anti")
    long = materialise(events.join(F.broadcast(cut), KEY, "left_semi"))     # read several times
    return _position_facts(_indexed_whole(ordinary), KEY), _position_facts(indexed_runs(long, cut, run_packets), KEY + ["run"])


def folded_streams(events: DataFrame, cut: DataFrame | None = None, run_packets: int = RUN_PACKETS) -> DataFrame:
    """``stream_facts`` of all streams. Only the packets of cut streams take part in more than one shuffle."""
    if cut is None:
        return stream_facts(ordered_rows(events))
    whole, runs = _whole_and_runs(events, cut, run_packets)
    return stream_facts(whole).unionByName(stream_facts(runs))


def _indexed_whole(events: DataFrame) -> DataFrame:
    order = W.partitionBy(KEY).orderBy("packet_no")
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = events.select(
        "*", F.row_number().over(order).cast("bigint").alias("packet_index"),
        F.first(F.when(F.col("src_ip").isNotNull(), _origin()), True).over(everything).alias("origin"),
        F.first("known_port", True).over(everything).alias("hint"))
    return _direction(rows).select(
        "*", F.lit(False).alias("copy"), F.lit(None).cast("bigint").alias("carried_ts"),
        F.lit(None).cast("string").alias("carried_tag"), F.lit(0).cast("bigint").alias("carried_offers"))


def _position_facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(keys).orderBy("packet_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    own = ~F.col("copy")
    index = F.col("packet_index")
    rows = rows.select(
        "*",
        F.coalesce(F.last(F.when(own, F.col("ts_us")), True).over(before), "carried_ts").alias("prev_ts"),
        (F.col("carried_offers")
         + F.coalesce(F.sum(F.when(own, F.size("offers")).otherwise(0)).over(before), F.lit(0))).alias("offers_before"),
        F.last(F.when(F.col("asks"), index), True).over(before).alias("command_index"),
        F.coalesce(F.last(F.when(own, F.col("tag")), True).over(before), "carried_tag").alias("current_tag"),
    )
    tagged = F.try_element_at(
        F.filter("answers", lambda a: a["tag"] == F.lower(F.col("current_tag"))), F.lit(1))["verdict"]
    awaited = (F.col("has_text") & ~F.col("from_client")
               & (index - F.col("command_index") <= RESPONSE_REACH))
    verdict = F.when(awaited, F.when(F.col("current_tag").isNull(), F.col("plain_verdict")).otherwise(tagged))
    rows = rows.withColumn("verdict", verdict)
    answered = F.last(F.when(F.col("verdict").isNotNull(), F.col("command_index")), True).over(before)
    return rows.withColumn("answered_index", answered).withColumn(
        "answer", F.when(own & ~F.col("answered_index").eqNullSafe(F.col("command_index")), F.col("verdict")))


# ---------------------------------------------------------------- the aggregates
def _first_of(value, present: Column) -> Column:
    return F.min_by(value, F.when(present, F.col("packet_no")))


def _last_of(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("packet_no")))


def stream_facts(rows: DataFrame) -> DataFrame:
    """One row of mergeable facts per stream; partial results leave each task."""
    no, own = F.col("packet_no"), ~F.col("copy")
    ends = F.struct("src_ip", "src_port", "dst_ip", "dst_port", "src_proto", "dst_proto")
    gap = F.col("ts_us") - F.col("prev_ts")
    plausible = gap.between(0, LONGEST_GAP_S * 1_000_000)

    def slot(position: int) -> Column:
        at = F.lit(position) - F.col("offers_before")
        hit = (at >= 1) & (at <= F.size("offers"))
        return F.max(F.when(hit, F.try_element_at("offers", at.cast("int"))))

    return rows.filter(own).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("bytes").alias("byte_count"),
        F.count_if("retransmission").alias("retransmission_count"),
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.min("packet_no").alias("first_no"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.coalesce(F.sum(F.when(plausible, gap)), F.lit(0)).alias("stepped_us"),
        F.min("rel_s").alias("rel_min"), F.max("rel_s").alias("rel_max"),
        F.coalesce(_first_of(ends, F.col("src_ip").isNotNull()), F.max_by(ends, no)).alias("ends"),
        *[F.count_if(F.col("layer") == p).alias(f"n_{p}") for p in PROTOCOLS],
        *[F.min(F.when(F.col("layer") == p, no)).alias(f"at_{p}") for p in PROTOCOLS],
        F.count_if(F.col("layer").isNull()).alias("n_none"),
        F.min(F.when(F.col("layer").isNull(), no)).alias("at_none"),
        F.min(F.when(F.col("is_tls"), no)).alias("tls_from"),
        F.bit_or(F.when(F.col("server_hello"), F.col("version_mask")).otherwise(0)).alias("server_mask"),
        F.bit_or(F.when(F.col("client_hello"), F.col("version_mask")).otherwise(0)).alias("offer_mask"),
        F.bit_or("version_mask").alias("record_mask"),
        F.count_if("client_hello").alias("client_hellos"),
        F.bool_or("server_hello").alias("server_hello_seen"),
        F.bool_or("certificate").alias("certificate_seen"),
        F.bool_or("alert").alias("alert_seen"),
        F.count_if("failure").alias("handshake_failures"),
        _last_of("chosen_suite").alias("chosen_suite"),
        _last_of("sni").alias("sni"),
        _last_of("key_group").alias("named_group"),
        _first_of("leaf", F.col("leaf").isNotNull()).alias("leaf_fingerprint"),
        *[slot(i).alias(f"offer_{i}") for i in range(1, OFFERS_KEPT + 1)],
        F.bool_or(F.col("has_text") & ~F.col("from_client") & F.col("offers_upgrade")).alias("starttls_advertised"),
        F.min(F.when(F.col("asks"), no)).alias("command_from"),
        F.min(F.when(F.col("auth"), no)).alias("auth_from"),
        F.coalesce(F.bool_or(F.col("answer") == "positive"), F.lit(False)).alias("answered_yes"),
        F.coalesce(F.bool_or(F.col("answer") == "negative"), F.lit(False)).alias("answered_no"),
    )


# ----------------------------------------------------------------- the projection
# Each step lists its columns in order; a later column may use an earlier one of the same
# step (lateral alias), so that a step is a single projection.
def _add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select("*", *[column.alias(name) for name, column in columns.items()])


def with_endpoints(facts: DataFrame) -> DataFrame:
    """Client and server side: the side on a known port serves, destination first."""
    server_is_src = F.col("ends.dst_proto").isNull() & F.col("ends.src_proto").isNotNull()

    def side(when_src: str, otherwise: str) -> Column:
        return F.when(server_is_src, F.col(f"ends.{when_src}")).otherwise(F.col(f"ends.{otherwise}"))

    return _add(facts, {
        "client_ip": side("dst_ip", "src_ip"), "client_port": side("dst_port", "src_port"),
        "server_ip": side("src_ip", "dst_ip"), "server_port": side("src_port", "dst_port"),
        "port_proto": F.coalesce("ends.src_proto", "ends.dst_proto"),
    })


def with_protocol(facts: DataFrame) -> DataFrame:
    """Most frequent packet protocol, the earlier one on a tie; ports only as a fallback."""
    ballots = []
    for p in PROTOCOLS:
        by_port = F.col("port_proto") == p
        votes = F.col(f"n_{p}") + F.when(by_port, F.col("n_none")).otherwise(0)
        first = F.least(F.col(f"at_{p}"), F.when(by_port, F.col("at_none")))
        ballots.append(F.when(votes > 0, F.struct(votes.alias("votes"), (-first).alias("rank"), F.lit(p).alias("name"))))
    return _add(facts, {
        "voted": F.array_max(F.array_compact(F.array(*ballots)))["name"],
        "protocol": F.coalesce("voted", "port_proto", F.lit("UNKNOWN")),
        "protocol_confidence": F.when(F.col("voted").isNotNull(), 0.98)
                                .when(F.col("protocol") != "UNKNOWN", 0.82).otherwise(0.0),
    }).drop("voted")


def with_duration(facts: DataFrame) -> DataFrame:
    span = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0))
    return _add(facts, {"duration_ms": F.coalesce(
        F.when(span <= LONGEST_SESSION_S * 1_000_000, span / 1e6 * 1000),
        F.when(span.isNotNull(), F.col("stepped_us") / 1e6 * 1000),
        F.greatest((F.col("rel_max") - F.col("rel_min")) * 1000, F.lit(0.0)),
        F.lit(0.0))})


def with_upgrade(facts: DataFrame) -> DataFrame:
    """STARTTLS/STLS outcome and clear-text credentials, with their evidence sentences."""
    command, started = F.col("command_from"), F.col("tls_from")
    yes, no, reached = F.col("answered_yes"), F.col("answered_no"), F.col("handshake_after_command")
    said = {
        "advertised": F.col("starttls_advertised"),
        "command": F.col("starttls_command"),
        "accepted": yes,
        "rejected": no & F.col("starttls_rejected"),
        "refused_first": no & ~F.col("starttls_rejected"),
        "upgraded": reached,
        "implicit": F.col("implicit_tls"),
        "clear_auth": F.col("plaintext_auth"),
    }
    return _add(facts, {
        "starttls_command": command.isNotNull(),
        "handshake_after_command": F.coalesce(command <= started, F.lit(False)),
        "implicit_tls": F.coalesce(F.col("server_port").isin(*IMPLICIT_TLS_PORTS), F.lit(False)),
        "tls_detected": started.isNotNull() | F.col("implicit_tls"),
        "plaintext_auth": F.col("auth_from").isNotNull() & F.coalesce(F.col("auth_from") < started, F.lit(True)),
        "starttls_accepted": F.when(yes | reached, True).when(no, False),
        "starttls_rejected": ~yes & no & ~reached,
        "upgrade_successful": reached | F.col("implicit_tls"),
        "starttls_evidence": F.array_compact(F.array(*[F.when(c, F.lit(EVIDENCE[k])) for k, c in said.items()])),
    })


def with_version(facts: DataFrame) -> DataFrame:
    by_server, by_record = F.col("by_server"), F.col("by_record")
    return _add(facts, {
        "by_server": tls.mask_highest(F.col("server_mask")),
        "by_record": F.when(F.col("server_hello_seen"), tls.mask_highest(F.col("record_mask"))),
        "tls_version": F.coalesce(by_server, by_record),
        "version_source": F.when(by_server.isNotNull(), "SERVER_HELLO")
                           .when(by_record.isNotNull(), "RECORD_LAYER").otherwise("UNKNOWN"),
        "offered_versions": tls.mask_versions(F.col("offer_mask")),
    }).drop("by_server", "by_record")


def with_cipher(facts: DataFrame) -> DataFrame:
    """The last suite a server chose; what only a client offered stays an offer."""
    names = [f"offer_{i}" for i in range(1, OFFERS_KEPT + 1)]
    chosen = F.col("chosen_suite").isNotNull()
    return _add(facts, {
        "suite": F.when(chosen, tls.cipher_profile(F.col("chosen_suite"))),
        "offered_ciphers": F.transform(F.array_compact(F.array(*names)), tls.cipher_display),
        "cipher_suite": F.col("suite.display"),
        "cipher_source": F.when(chosen, "SERVER_HELLO")
                          .when(F.coalesce(*names).isNotNull(), "CLIENT_OFFER").otherwise("UNKNOWN"),
        "key_exchange": F.col("suite.key_exchange"),
        "forward_secrecy": F.col("suite.forward_secrecy"),
        "cipher_strength": F.coalesce("suite.strength", F.lit(0)),
        "cipher_known": F.coalesce("suite.known", F.lit(False)),
    }).drop("suite", *names)


def with_handshake(facts: DataFrame) -> DataFrame:
    full = F.col("handshake_complete") & F.col("certificate_seen")
    return _add(facts, {
        "client_hello_seen": F.col("client_hellos") > 0,
        "repeated_client_hellos": F.greatest(F.col("client_hellos") - 1, F.lit(0)),
        "handshake_complete": (F.col("client_hellos") > 0) & F.col("server_hello_seen"),
        "handshake_status": F.when(full, "COMPLETE").when(F.col("tls_detected"), "PARTIAL").otherwise("UNKNOWN"),
        "stream_status": F.when(F.col("tls_detected") & ~full, "PARTIAL")
                          .when(F.col("first_frame").isNotNull(), "COMPLETE").otherwise("UNKNOWN"),
        "handshake_duration_ms": F.when(F.col("handshake_complete"), F.col("duration_ms")),
        "session_id": F.concat(F.lit("tcp.stream."), F.col("stream_id")),
    })


_WORKING = ["ends", "at_none", "n_none", "server_mask", "offer_mask", "record_mask", "stepped_us", "rel_min", "rel_max",
            "handshake_after_command"] + [f"{k}_{p}" for k in ("n", "at") for p in PROTOCOLS]


def finish_sessions(facts: DataFrame) -> DataFrame:
    """Flat session rows, certificate facts still to be attached."""
    for step in (with_endpoints, with_protocol, with_duration, with_upgrade, with_version, with_cipher, with_handshake):
        facts = step(facts)
    return facts.drop(*_WORKING)


def sessionise(packets: DataFrame, discovered: DataFrame | None = None,
               split_above: int | None = SPLIT_ABOVE, run_packets: int = RUN_PACKETS) -> DataFrame:
    """Packets (schemas.PACKET_SCHEMA) to one flat session row per stream.

    ``split_above=None`` skips the look for long streams where they are known not to occur.
    """
    cut = None if split_above is None else long_streams(packets, split_above)
    return finish_sessions(folded_streams(packet_events(packets, discovered), cut, run_packets))


# ------------------------------------------------------------------ nested record
_TLS = {
    "detected": "tls_detected", "handshake_status": "handshake_status", "client_hello_seen": "client_hello_seen",
    "server_hello_seen": "server_hello_seen", "certificate_seen": "certificate_seen", "tls_version": "tls_version",
    "version_source": "version_source", "offered_versions": "offered_versions", "cipher_suite": "cipher_suite",
    "cipher_source": "cipher_source", "offered_cipher_suites": "offered_ciphers", "key_exchange": "key_exchange",
    "forward_secrecy": "forward_secrecy", "named_group": "named_group", "sni": "sni", "alert_seen": "alert_seen",
    "handshake_failures": "handshake_failures", "repeated_client_hellos": "repeated_client_hellos",
    "handshake_duration_ms": "handshake_duration_ms",
}
_STARTTLS = {
    "advertised": "starttls_advertised", "command_seen": "starttls_command", "accepted": "starttls_accepted",
    "rejected": "starttls_rejected", "upgrade_successful": "upgrade_successful", "implicit_tls": "implicit_tls",
    "plaintext_authentication_seen": "plaintext_auth", "evidence": "starttls_evidence",
}
_SESSION = ["capture", "session_id", "client_ip", "client_port", "server_ip", "server_port", "protocol",
            "protocol_confidence", "first_frame", "last_frame", "duration_ms", "packet_count", "byte_count",
            "retransmission_count", "stream_status"]


def session_record(sessions: DataFrame) -> DataFrame:
    """Nested record per session, in the shape a stored analysis keeps."""
    def nest(parts: dict[str, str]) -> Column:
        return F.struct(*[F.col(source).alias(name) for name, source in parts.items()])

    columns = [c for c in sessions.columns if c.startswith("cert_")]
    nested = [nest(_STARTTLS).alias("starttls"),
              F.struct(*nest_fields(_TLS), F.lit(None).cast("boolean").alias("session_resumed"),
                       F.lit(None).cast("string").alias("signature_algorithm")).alias("tls")]
    if columns:
        nested.append(nest({c.removeprefix("cert_"): c for c in columns}).alias("certificate"))
    return sessions.select(
        *_SESSION, F.col("stream_id").alias("tcp_stream_id"),
        F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), *nested,
        *[c for c in ("findings", "policy_risk_score", "posture_score", "policy_risk_class",
                      "evidence_completeness") if c in sessions.columns])


def nest_fields(parts: dict[str, str]) -> list[Column]:
    return [F.col(source).alias(name) for name, source in parts.items()]
