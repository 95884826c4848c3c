"""Report and catalogue queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sealcheck.operators.scoring import severity_order
from sealcheck.session import materialise
from sealcheck.tables import SEVERITIES

HEAVY = ("sessions", "findings", "recommendations")


# ------------------------------------------------------------------ stored analyses
def list_analyses(analyses: DataFrame, summary_only: bool = False) -> DataFrame:
    """Reverse id order; the light form never reads the heavy columns."""
    kept = [c for c in analyses.columns if not (summary_only and c in HEAVY)]
    return analyses.select(*kept).orderBy(F.desc("analysis_id"))


def get_session(sessions: DataFrame, analysis_id, wanted: str) -> DataFrame:
    """First session of an analysis whose session or stream id is ``wanted``."""
    hit = (F.col("analysis_id") == analysis_id) & ((F.col("session_id") == wanted) | (F.col("stream_id") == wanted))
    return sessions.filter(hit).orderBy(F.coalesce("first_frame", F.lit(0)), "session_id").limit(1)


def current_version_only(analyses: DataFrame, version: str) -> DataFrame:
    return analyses.filter(F.col("analyzer_version") == version).orderBy(F.desc("created_at"))


def newest_per_capture(analyses: DataFrame, version: str, match: str = "", limit: int = 0) -> DataFrame:
    """Newest analysis per file name, name filter, optional limit; newest first."""
    wanted = analyses.filter(F.col("analyzer_version") == version)
    if match:
        wanted = wanted.filter(F.lower("source_filename").contains(match.lower()))
    # ids first: the documents themselves take no part in the aggregate
    ids = wanted.groupBy("source_filename").agg(F.max(F.struct("created_at", "analysis_id")).alias("newest"))
    newest = wanted.join(ids.select(F.col("newest.analysis_id").alias("analysis_id")), "analysis_id", "left_semi").select(*analyses.columns)
    newest = newest.orderBy(F.desc("created_at"))
    return newest.limit(limit) if limit else newest


def retention(analyses: DataFrame, version: str, keep: int = 0, stale_only: bool = False) -> DataFrame:
    """Analyses to drop: stale ones, or all but the ``keep`` newest."""
    if stale_only:
        return analyses.filter(F.col("analyzer_version") != version)
    kept = analyses.orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(keep).select("analysis_id")
    return analyses.join(F.broadcast(kept), "analysis_id", "left_anti")     # at most ``keep`` ids


def total_size(selected: DataFrame) -> DataFrame:
    return selected.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


# ------------------------------------------------------------------ one report
def ranked_sessions(scored: DataFrame, limit: int = 200) -> DataFrame:
    """Highest-risk sessions with the number of sessions not shown."""
    scored = materialise(scored)        # counted and ranked
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    top = scored.orderBy(F.desc("policy_risk_score"), "capture", F.coalesce("first_frame", F.lit(0)), "session_id").limit(limit)
    return top.join(F.broadcast(total)).withColumn("not_shown", F.greatest(F.col("total") - limit, F.lit(0)))   # one row


def top_findings_report(flat: DataFrame, limit: int = 40) -> DataFrame:
    flat = materialise(flat)        # counted and listed
    total = flat.agg(F.count(F.lit(1)).alias("total"))
    return flat.limit(limit).join(F.broadcast(total))      # one row


def matches(text: str, *columns: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))


def search_findings(flat: DataFrame, text: str) -> DataFrame:
    joined = flat.withColumn("evidence_text", F.array_join("evidence", " "))
    return joined.filter(matches(text, "code", "title", "description", "session_id", "severity", "evidence_text",
                                 "recommendation")).drop("evidence_text")


def search_sessions(scored: DataFrame, text: str) -> DataFrame:
    return scored.filter(matches(text, "session_id", "protocol", "server_port", "tls_version", "cipher_suite",
                                 "policy_risk_class", "ml_class"))


def severity_distribution(flat: DataFrame) -> DataFrame:
    """Zero-filled counts per severity and the width of their bars in percent of the largest."""
    counts = flat.groupBy().agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    largest = F.greatest(*SEVERITIES, F.lit(1))
    bars = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(len(SEVERITIES) - i).alias("position"), F.col(s).alias("n"),
                              F.bround(F.col(s) / largest * 100, 0).cast("int").alias("width"))
                     for i, s in enumerate(SEVERITIES)])
    return counts.select(F.explode(bars).alias("bar")).select("bar.*")


def _listed(column: str) -> Column:
    entries = F.array_sort(F.map_entries(column))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" x"), e["value"])), ", ")
    return F.when(F.size(column) > 0, text).otherwise("-")


def capture_facts(summary: DataFrame) -> DataFrame:
    note = F.when(F.col("plaintext_sessions") > 0, F.concat(
        F.col("plaintext_sessions"), F.lit(" of "), F.col("total_sessions"),
        F.lit(" sessions carry mail without encryption."))).otherwise("")
    return summary.select("capture", _listed("protocols").alias("protocols"), _listed("tls_versions").alias("tls_versions"),
                          _listed("ciphers").alias("ciphers"), note.alias("plaintext_note"))


def upgrade_label() -> Column:
    return (F.when(F.col("upgrade_successful"), "upgraded").when(F.col("starttls_rejected"), "rejected")
            .when(F.col("tls_detected"), "-").otherwise("cleartext"))


def manifest_upgrade_label() -> Column:
    return (F.when(F.col("implicit_tls"), "implicit TLS").when(F.col("starttls_rejected"), "REJECTED")
            .when(F.col("upgrade_successful"), "upgraded").when(F.col("starttls_command"), "requested, unconfirmed")
            .when(F.col("starttls_advertised"), "advertised only").otherwise("-"))


def sample_manifest(scored: DataFrame) -> DataFrame:
    """Per capture: protocols, worst class, agreement and counts."""
    names = ("IMAP", "POP3", "SMTP", "UNKNOWN")
    seen = F.array_compact(F.array(*[F.when(F.col(f"has_{p}"), F.lit(p)) for p in names]))
    order = severity_order(F.col("policy_risk_class"))
    totals = scored.groupBy("capture").agg(
        *[F.bool_or(F.col("protocol") == p).alias(f"has_{p}") for p in names],
        F.count(F.lit(1)).alias("sessions"), F.count_if("tls_detected").alias("tls"),
        F.sum(F.size("findings")).alias("findings"), F.max_by("policy_risk_class", order).alias("worst_class"),
        F.count_if(F.col("ml_class") == F.col("policy_risk_class")).alias("agree"))
    return totals.select("capture", F.array_join(seen, "/").alias("protocols"), "sessions", "tls", "findings", "worst_class",
                         F.concat("agree", F.lit("/"), "sessions").alias("agreement"))


def manifest_sessions(scored: DataFrame, shown: int = 8) -> DataFrame:
    """The first sessions of each capture as text columns, and how many more there are."""
    order = W.partitionBy("capture").orderBy(F.coalesce("first_frame", F.lit(0)), "session_id")
    top = scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= shown)
    totals = scored.groupBy("capture").agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("more"))
    version = F.when(F.col("tls_version").isNotNull(), F.concat("tls_version", F.lit(" ("), "version_source", F.lit(")"))) \
               .when(F.col("tls_detected"), F.concat(F.lit("UNKNOWN ("), "version_source", F.lit(")"))).otherwise("-")
    cipher = F.coalesce("cipher_suite", F.when(F.col("cipher_source") == "CLIENT_OFFER", "UNKNOWN (client offer only)"), F.lit("-"))
    cleartext = F.when(~F.col("tls_detected"), "session without TLS").when(F.col("plaintext_auth"), "YES").otherwise("no")
    return top.join(totals, "capture").select(
        "capture", "position", "session_id", F.concat("protocol", F.lit(":"), "server_port").alias("service"),
        manifest_upgrade_label().alias("upgrade"), version.alias("version"), cipher.alias("cipher"),
        cleartext.alias("cleartext"), "more")


def ml_disagreement_flag(scored: DataFrame) -> DataFrame:
    return scored.select("capture", "session_id", "policy_risk_class", "ml_class",
                         (F.upper("policy_risk_class") != F.upper("ml_class")).alias("disagrees"))
