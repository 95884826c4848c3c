"""Scores, classes and roll-ups to capture and fleet level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sealcheck.operators.rules import finding_rows
from sealcheck.session import materialise
from sealcheck.tables import BASELINE_ADVICE, CRITICAL_SCORE_FLOOR, RISK_BANDS, SEVERITIES, TLS_VERSIONS

PROTOCOL_NAMES = ("IMAP", "POP3", "SMTP", "UNKNOWN")

# ------------------------------------------------------------------ one session


def severity_order(severity: Column) -> Column:
    known = F.array(*map(F.lit, SEVERITIES))
    return F.greatest(F.array_position(known, severity) - 1, F.lit(0)).cast("int")


def risk_band(score: Column) -> Column:
    result = F.lit("LOW")
    for floor, label in reversed(RISK_BANDS):
        result = F.when(score >= floor, label).otherwise(result)
    return result


def risk_class(severities: Column, score: Column) -> Column:
    """Worst of CRITICAL, HIGH, MEDIUM; INFO and LOW never lift a session."""
    return (F.when(score >= CRITICAL_SCORE_FLOOR, "CRITICAL")
            .when(F.array_contains(severities, "CRITICAL"), "CRITICAL")
            .when(F.array_contains(severities, "HIGH"), "HIGH")
            .when(F.array_contains(severities, "MEDIUM"), "MEDIUM")
            .otherwise("LOW"))


def evidence_completeness() -> Column:
    no_tls = ~F.coalesce("tls_detected", F.lit(False))
    items = [
        F.col("protocol") != "UNKNOWN",
        F.col("packet_count") > 0,
        no_tls | F.col("tls_version").isNotNull(),
        no_tls | F.col("cipher_suite").isNotNull(),
        no_tls | F.coalesce("cert_present", F.lit(False)),
    ]
    total = F.lit(0)
    for item in items:
        total = total + item.cast("int")
    return F.bround(total / F.lit(5.0), 2)


def score_sessions(assessed: DataFrame) -> DataFrame:
    """Risk score, posture, class and completeness from the findings array."""
    impacts = F.transform("findings", lambda f: F.greatest(f["score_impact"], F.lit(0)))
    raw = F.aggregate(impacts, F.lit(0), lambda total, x: total + x)
    return (assessed
            .withColumn("policy_risk_score", F.least(F.lit(100), raw))
            .withColumn("posture_score", F.lit(100) - F.col("policy_risk_score"))
            .withColumn("policy_risk_class", risk_class(F.col("findings.severity"), F.col("policy_risk_score")))
            .withColumn("evidence_completeness", evidence_completeness()))


# ------------------------------------------------------------------ findings
def session_place() -> Column:
    """Order of sessions inside a capture."""
    return F.struct(F.coalesce("first_frame", F.lit(0)).alias("frame"), F.col("session_id").alias("sid"))


def flatten_findings(assessed: DataFrame) -> DataFrame:
    """All findings, worst first, as one globally sorted table."""
    return (finding_rows(assessed)
            .withColumn("severity_rank", severity_order(F.col("severity")))
            .orderBy(F.desc("severity_rank"), F.desc("score_impact"), "title",
                     "capture", F.coalesce("first_frame", F.lit(0)), "session_id", "emitted"))


def top_findings(assessed: DataFrame, limit: int = 5) -> DataFrame:
    """Highest impact first, one row per code, at most ``limit`` per capture.

    Codes are reduced before anything is ranked: 23 rows per capture at most.
    """
    place = F.struct((-F.col("score_impact")).alias("worse"), session_place().alias("place"), "emitted")
    codes = (finding_rows(assessed).groupBy("capture", "code")
             .agg(F.min(F.struct(place.alias("place"), "severity", "title", "score_impact")).alias("best")))
    rank = F.row_number().over(W.partitionBy("capture").orderBy("best.place"))
    return (codes.withColumn("rank", rank).filter(F.col("rank") <= limit)
            .select("capture", "rank", "code", "best.severity", "best.title", "best.score_impact"))


def recommendations(assessed: DataFrame) -> DataFrame:
    """Distinct advice per capture by first appearance, baseline advice at the end."""
    def told(part: int, emitted: Column, advice: Column) -> Column:
        return F.struct(advice.alias("advice"), F.struct(F.lit(part).alias("part"), emitted.alias("emitted")).alias("at"))

    own = F.transform("findings", lambda f, i: told(0, i, f["recommendation"]))
    base = F.array(*[told(1, F.lit(i), F.lit(t)) for i, t in enumerate(BASELINE_ADVICE)])
    rows = assessed.select("capture", "first_frame", "session_id", F.explode(F.concat(own, base)).alias("t")).select(
        "capture", F.col("t.advice").alias("advice"),
        F.struct("t.at.part", F.coalesce("first_frame", F.lit(0)).alias("frame"), F.col("session_id").alias("sid"),
                 F.col("t.at.emitted").alias("emitted")).alias("place"))
    first = rows.groupBy("capture", "advice").agg(F.min("place").alias("place"))
    order = F.row_number().over(W.partitionBy("capture").orderBy("place"))   # <= 28 texts per capture
    return first.select("capture", order.alias("position"), "advice")


# ------------------------------------------------------------------ captures
def _occurrences(values: Column, wanted: str) -> Column:
    return F.size(F.filter(values, lambda v: v == wanted))


def _additive(scored: DataFrame) -> dict[str, Column]:
    """Measures of a set of sessions that add up over its parts."""
    severities, known = F.col("findings.severity"), F.col("protocol") != "UNKNOWN"
    given = set(scored.columns)
    none = F.lit(0).cast("bigint")
    measures = {
        "total_sessions": F.count(F.lit(1)),
        "tls_sessions": F.count_if("tls_detected"),
        "plaintext_sessions": F.count_if(~F.col("tls_detected") & known),
        "starttls_sessions": F.count_if(F.col("starttls_command") | F.col("starttls_advertised")),
        "successful_upgrades": F.count_if("upgrade_successful"),
        "anomalous_sessions": F.count_if("ml_anomalous") if "ml_anomalous" in given else F.max(none),
        "total_findings": F.sum(F.size("findings")),
        "ml_matches_rules": F.count_if(F.col("ml_class") == F.col("policy_risk_class")) if "ml_class" in given else F.max(none),
        "risk_sum": F.sum("policy_risk_score"),
        "completeness_sum": F.sum(F.bround(F.col("evidence_completeness") * 100, 0).cast("bigint")),
    }
    for level in SEVERITIES:
        measures[f"severity_{level.lower()}"] = F.sum(_occurrences(severities, level))
    for protocol in PROTOCOL_NAMES:
        measures[f"p_{protocol}"] = F.count_if(F.col("protocol") == protocol)
    for version in TLS_VERSIONS:
        measures[f"v_{version}"] = F.count_if(F.col("tls_version") == version)
    return measures


def _count_map(prefix: str, names) -> Column:
    """MAP of the non-zero counters, sorted by name."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{prefix}{n}`").alias("value")) for n in sorted(names)])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def capture_summary(scored: DataFrame) -> DataFrame:
    """One row per capture with counters and maps, in one pass over the sessions.

    Sessions are first reduced per (capture, cipher), which also gives the cipher map, so a
    capture with any share of the sessions is combined in the tasks that hold them.
    """
    measures = _additive(scored)
    worst = F.max(severity_order(F.col("policy_risk_class")))
    parts = scored.groupBy("capture", "cipher_suite").agg(
        *[c.alias(n) for n, c in measures.items()], worst.alias("worst"))
    suites = F.collect_list(F.when(F.col("cipher_suite").isNotNull(),
                                   F.struct(F.col("cipher_suite").alias("key"), F.col("total_sessions").alias("value"))))
    totals = parts.groupBy("capture").agg(
        *[F.sum(F.col(f"`{n}`")).alias(n) for n in measures], F.max("worst").alias("worst"), suites.alias("suites"))
    mean = F.bround(F.col("risk_sum") / F.col("total_sessions"), 0).cast("int")
    levels = []
    for level in SEVERITIES:
        levels += [F.lit(level), F.col(f"severity_{level.lower()}")]
    shown = [n for n in measures if not n.startswith(("p_", "v_")) and not n.endswith("_sum") and n != "ml_matches_rules"]
    return totals.select(
        "capture", *shown, mean.alias("overall_risk_score"), (F.lit(100) - mean).alias("overall_posture_score"),
        F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest("worst", F.lit(1)) + 1).alias("overall_risk_class"),
        F.bround(F.col("completeness_sum") / 100 / F.col("total_sessions"), 2).alias("evidence_completeness"),
        "ml_matches_rules", _count_map("p_", PROTOCOL_NAMES).alias("protocols"), _count_map("v_", TLS_VERSIONS).alias("tls_versions"),
        F.map_from_entries(F.array_sort("suites")).alias("ciphers"), F.create_map(*levels).alias("findings_by_severity"))


def ml_rule_agreement(scored: DataFrame) -> DataFrame:
    return scored.groupBy("capture").agg(
        F.count_if(F.col("ml_class") == F.col("policy_risk_class")).alias("ml_matches_rules"),
        F.count(F.lit(1)).alias("sessions"))


def batch_record(scored: DataFrame) -> DataFrame:
    """Summary, agreement and top findings flattened to one row per capture.

    Two passes read the sessions, so the few columns they need are written once.
    """
    needed = ["capture", "session_id", "first_frame", "protocol", "tls_detected", "starttls_command", "starttls_advertised",
              "upgrade_successful", "tls_version", "cipher_suite", "policy_risk_score", "policy_risk_class",
              "evidence_completeness", "findings", "ml_class", "ml_anomalous"]
    table = materialise(scored.select(*[c for c in needed if c in scored.columns]))
    top = top_findings(table).groupBy("capture").agg(F.transform(      # five rows at most
        F.array_sort(F.collect_list(F.struct("rank", "code", "severity", "title"))),
        lambda t: F.struct(t["code"], t["severity"], t["title"])).alias("top_findings"))
    return capture_summary(table).join(top, "capture", "left")


def feature_table_stats(table: DataFrame, top: int = 15) -> DataFrame:
    """Rows, captures, labels, agreement and the most common finding codes, long form."""
    def counted(kind: str, name: Column, source: DataFrame) -> DataFrame:
        return source.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")) \
                     .select(F.lit(kind).alias("kind"), "name", "n")

    table = materialise(table.select("capture", "risk_label", "ml_label", "finding_codes"))
    totals = table.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("capture").alias("captures"),
        F.count_if(F.col("risk_label") == F.col("ml_label")).alias("agreed"),
    ).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n"))
                                 for n in ("rows", "captures", "agreed")])).alias("t")) \
     .select(F.lit("total").alias("kind"), "t.name", "t.n")
    codes = table.select(F.explode(F.split("finding_codes", r"\|")).alias("code")).filter(F.col("code") != "")
    common = counted("finding", F.col("code"), codes).orderBy(F.desc("n"), "name").limit(top)
    return (totals.unionByName(counted("rule_label", F.col("risk_label"), table))
            .unionByName(counted("ml_label", F.col("ml_label"), table)).unionByName(common))


def run_totals(summary: DataFrame) -> DataFrame:
    """Sessions and class per capture plus a grand total."""
    total = summary.agg(F.lit("*").alias("capture"), F.sum("total_sessions").alias("sessions"),
                        F.count(F.lit(1)).alias("captures"), F.lit(None).cast("string").alias("risk_class"))
    rows = summary.select("capture", F.col("total_sessions").alias("sessions"), F.lit(1).cast("bigint").alias("captures"),
                          F.col("overall_risk_class").alias("risk_class"))
    return rows.unionByName(total)


def capture_check(scored: DataFrame) -> DataFrame:
    """Per capture: sessions, findings, worst session, mean posture, agreement."""
    place = F.struct(F.col("policy_risk_score").alias("score"),
                     (-F.coalesce("first_frame", F.lit(0))).alias("earlier"), F.col("session_id"))
    worst = F.max_by(F.struct("session_id", "policy_risk_score", "policy_risk_class"), place)
    return scored.groupBy("capture").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(F.size("findings")).alias("findings"),
        worst.alias("worst"), F.bround(F.avg("posture_score"), 0).cast("int").alias("posture"),
        F.count_if(F.col("ml_class") == F.col("policy_risk_class")).alias("agree"),
    ).select("capture", "sessions", "findings", F.col("worst.session_id").alias("worst_session"),
             F.col("worst.policy_risk_score").alias("worst_score"), F.col("worst.policy_risk_class").alias("worst_class"),
             "posture", "agree")
