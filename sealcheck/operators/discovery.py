"""Mail protocols on unusual ports, and encrypted streams nobody could name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sealcheck.functions import mailtext as mt, tls
from sealcheck.session import materialise, small_side
from sealcheck.tables import MAIL_PORTS, MAIL_VOCABULARY, MIN_VOCABULARY_SCORE

KNOWN = tuple(MAIL_PORTS)


def port_names(discovered: DataFrame) -> DataFrame:
    """(capture, ports): the protocol of each discovered port, one row per capture of at most 65,536 entries."""
    once = discovered.groupBy("capture", "port").agg(F.min("protocol").alias("protocol"))
    return once.groupBy("capture").agg(F.map_from_entries(F.collect_list(F.struct("port", "protocol"))).alias("ports"))


def port_bits(discovered: DataFrame) -> list[int]:
    """Bit p % 64 of long p // 64 is set where port p was discovered in any capture: 1,024 longs, however many captures there are."""
    bits = [0] * 1024
    for row in discovered.select((F.col("port") / 64).cast("int").alias("word"), (F.col("port") % 64).alias("bit")) \
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect():
        bits[row["word"]] = row["bits"]
    return bits


def touches(bits: list[int], port: Column) -> Column:
    """Is the port's bit set?"""
    inside = port.between(0, 65_535)
    word = F.get(F.array(*map(F.lit, bits)).cast("array<bigint>"), F.floor(port / 64).cast("int"))
    return F.coalesce(inside & (F.getbit(word, port % 64) == 1), F.lit(False))


def with_port_names(packets: DataFrame, discovered: DataFrame) -> DataFrame:
    """``packets`` with ``ports``, the discovered ports of their capture: one join on the capture, whose other side has a row per capture."""
    return packets.join(small_side(port_names(discovered)), "capture", "left")


def name_of(side: str) -> Column:
    return F.try_element_at("ports", F.col(side))


def mail_scope(packets: DataFrame, extra: DataFrame | None = None, exclude_ports=()) -> DataFrame:
    """Packets on a mail port (standard, or ``extra`` per capture) or with a mail layer.

    Packets that touch ``exclude_ports`` are dropped afterwards.
    """
    src, dst = F.col("src_port"), F.col("dst_port")
    listed = F.coalesce(src.isin(*KNOWN) | dst.isin(*KNOWN), F.lit(False)) | F.coalesce("has_mail_layer", F.lit(False))
    if extra is not None:
        bits = port_bits(extra)
        packets = with_port_names(packets.filter(listed | touches(bits, src) | touches(bits, dst)), extra.select("capture", "port", F.lit("").alias("protocol")))
        listed = listed | name_of("src_port").isNotNull() | name_of("dst_port").isNotNull()
    kept = packets.filter(listed)
    if exclude_ports:
        kept = kept.filter(~F.coalesce(src.isin(*exclude_ports) | dst.isin(*exclude_ports), F.lit(False)))
    return kept.drop("ports")


def payload_prefilter(packets: DataFrame) -> DataFrame:
    """Packets whose payload holds a mail word, with the decoded text (decoded once)."""
    decoded = F.filter(F.array(mt.payload_text(F.col("payload_hex"))), mt.has_mail_words)
    return (packets.filter(F.col("src_port").isNotNull())
            .select("capture", "packet_no", "src_port", "dst_port", F.explode(decoded).alias("text")))


def port_scores(candidates: DataFrame) -> DataFrame:
    """One column of summed scores per protocol for each (capture, port).

    Scores are computed per packet and summed in the tasks, so no payload is shuffled.
    """
    scored = candidates.select(
        "capture", mt.vocabulary_scores(F.col("text")).alias("scores"),
        F.array("src_port", F.coalesce("dst_port", "src_port")).alias("ports"),
    ).select("capture", "scores", F.explode("ports").alias("port"))
    return scored.groupBy("capture", "port").agg(
        *[F.sum(F.col("scores")[i]["score"]).alias(p) for i, p in enumerate(MAIL_VOCABULARY)])


def port_votes(candidates: DataFrame) -> DataFrame:
    """(capture, port, protocol, score), positive scores only."""
    return port_scores(candidates).unpivot(["capture", "port"], list(MAIL_VOCABULARY), "protocol", "score") \
                                  .filter(F.col("score") > 0)


def first_greeting(candidates: DataFrame) -> DataFrame:
    """Port that sent a protocol's first server greeting in a capture."""
    return (candidates.select("capture", "packet_no", "src_port",
                              F.explode(mt.greeting_protocols(F.col("text"))).alias("protocol"))
            .groupBy("capture", "protocol").agg(F.min_by("src_port", "packet_no").alias("port")))


def port_hints(candidates: DataFrame) -> DataFrame:
    """Clear winners on unknown ports: score of at least three and above the runner-up."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(p)).alias("down"), F.lit(p).alias("protocol"))
                                    for p in MAIL_VOCABULARY]))
    best, second = F.element_at("ranked", 1), F.element_at("ranked", 2)
    return (port_scores(candidates).filter(~F.col("port").isin(*KNOWN))
            .withColumn("ranked", ranked)
            .filter((-best["down"] >= MIN_VOCABULARY_SCORE) & (best["down"] < second["down"]))
            .select("capture", "port", best["protocol"].alias("protocol"), (-best["down"]).alias("score")))


def discovered_ports(packets: DataFrame) -> DataFrame:
    """(capture, port, protocol) of mail service on unusual ports.

    Ports whose greeting agrees with the vocabulary win; without any, a greeting from a
    standard port rules the capture out; otherwise every hint counts.
    """
    candidates = materialise(payload_prefilter(packets))     # packets with a mail word, decoded once, read for scores and greetings
    hints, greetings = port_hints(candidates).drop("score"), first_greeting(candidates)
    agreed = hints.join(greetings.withColumn("greeted", F.lit(True)), ["capture", "port", "protocol"], "left")
    per_capture = agreed.groupBy("capture").agg(F.coalesce(F.bool_or("greeted"), F.lit(False)).alias("any_greeted"))
    standard = greetings.groupBy("capture").agg(F.bool_or(F.col("port").isin(*KNOWN)).alias("known_greeting"))
    return (agreed.join(per_capture, "capture").join(standard, "capture", "left")
            .filter(F.coalesce("greeted", F.lit(False))
                    | (~F.col("any_greeted") & ~F.coalesce("known_greeting", F.lit(False))))
            .select("capture", "port", "protocol"))


def dissect_discovered(packets: DataFrame, discovered: DataFrame) -> DataFrame:
    """Packets of the second pass: discovered ports only, their payload read as dialogue.

    A bit test drops packets that no capture's discovery concerns before they meet the ports of their own capture; no packet is dealt by
    port, so a busy port is no hot key. The column ``ports`` stays for the fold.
    """
    bits, src, dst = port_bits(discovered), F.col("src_port"), F.col("dst_port")
    concerned = packets.filter((touches(bits, src) | touches(bits, dst)) & ~F.coalesce(src.isin(*KNOWN) | dst.isin(*KNOWN), F.lit(False)))
    joined = (with_port_names(concerned, discovered).withColumn("named", F.coalesce(name_of("src_port"), name_of("dst_port")))
              .filter(F.col("named").isNotNull()))
    spoken = F.col("payload_hex").isNotNull() & (F.col("payload_hex") != "") & ~F.coalesce("is_tls", F.lit(False))
    return joined.select(
        *[c for c in packets.columns if c not in ("layer_protocol", "mail_text", "has_mail_layer")],
        F.coalesce("layer_protocol", F.when(spoken, F.col("named"))).alias("layer_protocol"),
        F.coalesce("mail_text", F.when(spoken, mt.payload_text(F.col("payload_hex")))).alias("mail_text"),
        (F.col("layer_protocol").isNotNull() | spoken).alias("has_mail_layer"), "ports")


def merge_passes(first: DataFrame, extra: DataFrame) -> DataFrame:
    """Sessions of the first pass plus those only the second one found."""
    same = W.partitionBy("capture", "session_id", "server_port", "client_port")     # a session, seen once or twice
    both = first.withColumn("pass_no", F.lit(1)).unionByName(extra.withColumn("pass_no", F.lit(2)))
    kept = both.withColumn("earliest", F.min("pass_no").over(same)).filter(F.col("pass_no") == F.col("earliest"))
    return kept.drop("pass_no", "earliest")


def unclassified_tls(packets: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """TLS streams that did not become a mail session: ports, version, name, certificate."""
    no, hello = F.col("packet_no"), F.coalesce(F.array_contains("hs_types", "2"), F.lit(False))     # by type, not by text
    ends = F.struct("src_port", "dst_port", hello.alias("hello"))
    stated, legacy = tls.tls_version_name(F.col("supported_version")), tls.tls_version_name(F.col("legacy_version"))
    streams = packets.filter(F.col("is_tls") & F.col("stream_id").rlike("^[0-9]+$")).groupBy("capture", "stream_id").agg(
        F.min_by(ends, F.when(F.col("src_port").isNotNull() & F.col("dst_port").isNotNull(), no)).alias("ends"),
        F.min_by(stated, F.when(hello & stated.isNotNull(), no)).alias("stated"),
        F.max_by(legacy, F.when(hello & legacy.isNotNull(), no)).alias("legacy"),
        F.min_by("server_name", F.when(F.col("server_name") != "", no)).alias("server_name"),
        F.coalesce(F.bool_or(F.array_contains("hs_types", "11")), F.lit(False)).alias("certificate_visible"))
    if sessions is not None:
        streams = streams.join(sessions.select("capture", "stream_id"), ["capture", "stream_id"], "left_anti")
    by_hello = F.col("ends.hello")
    src, dst = F.col("ends.src_port"), F.col("ends.dst_port")
    return streams.select(
        "capture", F.col("stream_id").cast("bigint").alias("stream_no"),
        F.concat(F.lit("tcp.stream."), F.col("stream_id")).alias("session_id"),
        F.when(by_hello, src).otherwise(F.least(src, dst)).alias("server_port"),
        F.when(by_hello, dst).otherwise(F.greatest(src, dst)).alias("client_port"),
        F.coalesce("stated", "legacy").alias("tls_version"),
        F.when(F.col("stated").isNotNull(), "SERVER_HELLO").when(F.col("legacy").isNotNull(), "SERVER_HELLO_LEGACY")
         .otherwise("UNKNOWN").alias("tls_version_source"),
        "server_name", "certificate_visible")


def stream_description() -> Column:
    return F.concat_ws(
        ", ",
        F.concat(F.lit("port "), F.coalesce(F.col("server_port").cast("string"), F.lit("UNKNOWN"))),
        F.coalesce(F.concat("tls_version", F.lit(" (from "), "tls_version_source", F.lit(")")), F.lit("TLS version UNKNOWN")),
        F.concat(F.lit("client asked for "), F.col("server_name")),
        F.when(F.col("certificate_visible"), "certificate visible").otherwise("certificate NOT observable"))


def unclassified_note(streams: DataFrame, listed: int = 6) -> DataFrame:
    """One sentence per capture with the number of streams and the first ports."""
    totals = streams.groupBy("capture").agg(F.count(F.lit(1)).alias("n"),
                                            F.count_distinct("server_port").alias("n_ports"))
    ports = (streams.filter(F.col("server_port").isNotNull()).groupBy("capture", "server_port")
             .agg(F.min("stream_no").alias("first")))
    rank = F.row_number().over(W.partitionBy("capture").orderBy("first", "server_port"))
    shown = (ports.withColumn("rank", rank).filter(F.col("rank") <= listed).groupBy("capture")
             .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("server_port").cast("string").alias("port")))).alias("ports")))
    more = F.when(F.col("n_ports") > listed, F.concat(F.lit(" (+"), F.col("n_ports") - listed, F.lit(" more)"))).otherwise("")
    return totals.join(shown, "capture", "left").select("capture", "n", F.concat(
        F.col("n"), F.lit(" encrypted stream(s) were not attributed to a mail protocol (ports: "),
        F.coalesce(F.array_join("ports.port", ", "), F.lit("")), more,
        F.lit("). The protocol inside them cannot be proven from the capture, "
              "because implicit TLS hides all protocol vocabulary.")).alias("note"))


def capture_state(captures: DataFrame, packets: DataFrame, sessions: DataFrame, unclassified: DataFrame) -> DataFrame:
    """UNREADABLE, UNCLASSIFIED, NO_SESSIONS or SCORED: an empty result is not a clean one."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("capture").agg(F.count(F.lit(1)).alias(name))

    state = (captures.select("capture").join(counted(packets, "packets"), "capture", "left")
             .join(counted(sessions, "sessions"), "capture", "left")
             .join(counted(unclassified, "streams"), "capture", "left")
             .na.fill(0, ["packets", "sessions", "streams"]))
    return state.withColumn("state", F.when(F.col("sessions") > 0, "SCORED").when(F.col("streams") > 0, "UNCLASSIFIED")
                            .when(F.col("packets") == 0, "UNREADABLE").otherwise("NO_SESSIONS"))
