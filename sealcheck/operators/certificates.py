"""Certificate facts: validity, host names, chains, attachment to sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sealcheck.functions import tls

DAY = 86_400
CERT_RUN_PACKETS = 1_000_000


def validity_facts(certs: DataFrame, as_of_epoch: int, hostname: Column | None = None) -> DataFrame:
    """Validity at ``as_of_epoch``, key and signature strength and the status ladder.

    ``hostname`` is the result of the name comparison when a server name was asked for.
    """
    now = F.lit(as_of_epoch).cast("bigint")
    bits = F.coalesce("key_bits", F.lit(0))
    matched = F.lit(None).cast("boolean") if hostname is None else hostname
    return certs.select(
        "*", (now > F.col("valid_until_epoch")).alias("expired"), (now < F.col("valid_from_epoch")).alias("not_yet_valid"),
        F.floor((F.col("valid_until_epoch") - now) / DAY).cast("int").alias("days_remaining"),
        (F.col("subject") == F.col("issuer")).alias("self_signed"),
        F.lower(F.coalesce("sig_hash", F.lit(""))).isin("md5", "sha1").alias("weak_signature"),
        F.coalesce(((F.col("key_algorithm") == "RSA") & (bits < 2048)) | ((F.col("key_algorithm") == "EC") & (bits < 256)),
                   F.lit(False)).alias("weak_key"),
        F.coalesce(F.concat(F.coalesce("sig_hash", F.lit("unknown")), F.lit("-"), F.col("key_algorithm")),
                   "sig_hash").alias("signature_algorithm"),
        matched.alias("hostname_match"), certificate_status().alias("status"))


def certificate_status(prefix: str = "") -> Column:
    def fact(name: str) -> Column:
        return F.col(prefix + name)

    return (F.when(fact("expired"), "EXPIRED").when(fact("not_yet_valid"), "NOT_YET_VALID")
            .when(~fact("hostname_match"), "HOSTNAME_MISMATCH").when(fact("weak_key"), "WEAK_KEY")
            .when(fact("weak_signature"), "WEAK_SIGNATURE").when(fact("self_signed"), "SELF_SIGNED")
            .otherwise("VALID"))


def sent_certificates(packets: DataFrame) -> DataFrame:
    """Usable certificate values of every packet, in stream order.

    A packet without TLS has no values: a filter would be pushed below the packets' own projections, whose expressions it then repeats.
    """
    return packets.select(
        "capture", F.coalesce("stream_id", F.concat(F.lit("unknown-"), F.col("packet_no"))).alias("stream_id"),
        "packet_no", F.posexplode(tls.certificate_candidates(F.when(F.col("is_tls"), F.col("cert_values")))).alias("slot", "fingerprint"))


def chain_status(sent: DataFrame, certs: DataFrame, run_packets: int = CERT_RUN_PACKETS) -> DataFrame:
    """Is every issuer the subject of the next certificate? One row per stream.

    ``sent`` has capture, stream_id, packet_no, slot and fingerprint; unreadable
    certificates (no row in ``certs``) are skipped. Neighbours are compared inside runs of
    packets and once more between the ends of consecutive runs, so a stream of any length
    is folded in parallel.
    """
    key = ["capture", "stream_id"]
    known = certs.select("fingerprint", "subject", "issuer")
    rows = sent.join(known, "fingerprint", "inner").withColumn("run", F.floor(F.col("packet_no") / run_packets))
    place = F.struct("packet_no", "slot")
    in_run = W.partitionBy(key + ["run"]).orderBy("packet_no", "slot")
    rows = rows.withColumn("next_subject", F.lead("subject").over(in_run))
    runs = rows.groupBy(key + ["run"]).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_and(F.when(F.col("next_subject").isNotNull(), F.col("issuer") == F.col("next_subject"))),
                   F.lit(True)).alias("linked"),
        F.min_by(F.struct("subject", "issuer"), place).alias("first"),
        F.max_by(F.struct("subject", "issuer"), place).alias("last"))
    across = W.partitionBy(key).orderBy("run")
    joined = F.coalesce(F.col("last.issuer") == F.lead("first.subject").over(across), F.lit(True))
    chains = runs.withColumn("joined", joined).groupBy(key).agg(
        F.sum("n").alias("chain_length"),
        F.bool_and(F.col("linked") & F.col("joined")).alias("linked"),
        F.min_by("first", "run").alias("first"), F.max_by("last", "run").alias("last"))
    own_root = F.col("last.subject") == F.col("last.issuer")
    single = F.col("chain_length") == 1
    return chains.select(
        *key, F.col("chain_length").cast("int").alias("chain_length"),
        F.when(single, F.when(own_root, "SELF_SIGNED").otherwise("INCOMPLETE"))
         .when(~F.col("linked"), "INCOMPLETE")
         .when(own_root, "COMPLETE").otherwise("COMPLETE_UNVERIFIED_ROOT").alias("chain_status"),
        F.when(single, own_root).otherwise(F.col("linked")).alias("chain_complete"))


_ATTACHED = ("subject", "issuer", "common_name", "sans", "days_remaining", "expired", "not_yet_valid", "self_signed",
             "key_algorithm", "key_bits", "signature_algorithm", "weak_signature", "weak_key",
             "valid_from_epoch", "valid_until_epoch")


_TEXT = ("subject", "issuer", "common_name", "key_algorithm", "signature_algorithm")
_FLAGS = ("expired", "not_yet_valid", "self_signed", "weak_signature", "weak_key")


def attach_certificates(sessions: DataFrame, certs: DataFrame | None = None, chains: DataFrame | None = None,
                        as_of_epoch: int = 0) -> DataFrame:
    """Add cert_* facts of each session's leaf certificate.

    No usable value: absent. A value without facts: present, everything else unknown.
    """
    leaf, df = F.col("leaf_fingerprint"), sessions
    if chains is not None:      # same key as the fold: no further shuffle of the sessions
        df = df.join(chains, ["capture", "stream_id"], "left")
        state, length, complete = F.col("chain_status"), F.col("chain_length"), F.col("chain_complete")
    else:
        state, length, complete = (F.lit(None).cast(t) for t in ("string", "int", "boolean"))
    if certs is None:
        nothing = F.lit(None)
        df = df.select("*", F.lit(False).alias("cert_readable"), *[
            nothing.cast("array<string>" if c == "sans" else "string" if c in _TEXT else
                         "boolean" if c in _FLAGS else "bigint").alias(f"cert_{c}") for c in _ATTACHED])
    else:
        # Sessions without a leaf get a key of their own, so that they do not meet in one task.
        df = df.withColumn("leaf_key", F.coalesce(leaf, F.concat_ws(" ", F.lit("none"), "capture", "stream_id")))
        facts = validity_facts(certs, as_of_epoch).select(
            F.col("fingerprint").alias("leaf_key"), F.lit(True).alias("cert_readable"),
            *[F.col(c).alias(f"cert_{c}") for c in _ATTACHED])
        df = df.join(facts, "leaf_key", "left")
    readable = F.coalesce("cert_readable", F.lit(False))
    return df.select(
        "*", leaf.isNotNull().alias("cert_present"), leaf.alias("cert_fingerprint"),
        F.when(readable, tls.hostname_match(F.col("cert_sans"), F.col("cert_common_name"), F.col("sni")))
         .alias("cert_hostname_match"),
        F.when(readable, F.coalesce(state, F.lit("UNKNOWN"))).otherwise("UNKNOWN").alias("cert_chain_status"),
        F.when(readable, F.coalesce(length, F.lit(1))).otherwise(0).alias("cert_chain_length"),
        F.when(readable, complete).alias("cert_chain_complete"),
        F.when(readable, certificate_status("cert_")).otherwise("UNKNOWN").alias("cert_status"),
    ).withColumn("cert_weak_signature", F.coalesce("cert_weak_signature", F.lit(False))) \
     .drop("cert_readable", "leaf_fingerprint", "leaf_key", "chain_status", "chain_length", "chain_complete")
