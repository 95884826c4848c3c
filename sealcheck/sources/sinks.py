"""Records, flat tables, stored analyses and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealcheck.operators.features import feature_columns


def write_captures(records: DataFrame, path: str) -> None:
    """One JSON line per capture, appended so that finished work is never lost."""
    records.write.mode("append").json(path)


def _pairs(column: str) -> Column:
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


CAPTURE_COLUMNS = (
    "capture", "ok", "seconds", "size_bytes", "sessions", "tls_sessions", "cleartext_sessions", "starttls_sessions",
    "successful_upgrades", "total_findings", "severity_critical", "severity_high", "severity_medium", "severity_low",
    "severity_info", "posture", "risk_class", "risk_score", "evidence_completeness", "ml_matches_rules", "ml_status",
    "protocols", "tls_versions", "top_findings", "error",
)


def capture_csv(records: DataFrame) -> DataFrame:
    """25 flat columns per capture from operators.scoring.batch_record rows."""
    given = set(records.columns)

    def optional(name: str, default: Column) -> Column:
        return F.col(name) if name in given else default

    top = F.array_join(F.transform("top_findings", lambda t: F.concat(t["severity"], F.lit(":"), t["code"])), " | ")
    values = {
        "ok": optional("ok", F.lit(True)), "seconds": optional("seconds", F.lit(0.0)),
        "size_bytes": optional("size_bytes", F.lit(0).cast("bigint")), "sessions": F.col("total_sessions"),
        "cleartext_sessions": F.col("plaintext_sessions"), "posture": F.col("overall_posture_score"),
        "risk_class": F.col("overall_risk_class"), "risk_score": F.col("overall_risk_score"),
        "ml_status": optional("ml_status", F.lit("")), "protocols": _pairs("protocols"),
        "tls_versions": _pairs("tls_versions"), "top_findings": F.coalesce(top, F.lit("")),
        "error": optional("error", F.lit("")),
    }
    return records.select(*[values.get(c, F.col(c)).alias(c) for c in CAPTURE_COLUMNS])


def write_csv(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).option("header", "true").csv(path)


def finding_codes() -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.col("findings.code"))), "|")


def feature_table(scored: DataFrame) -> DataFrame:
    """Session metadata first, then the features in their order."""
    meta = [
        "capture", "session_id", "protocol", "tls_version", "cipher_suite",
        F.col("policy_risk_class").alias("risk_label"), F.col("ml_class").alias("ml_label"),
        F.col("policy_risk_score").alias("risk_score"), "evidence_completeness",
        F.size("findings").alias("finding_count"), finding_codes().alias("finding_codes"),
    ]
    return scored.select(*meta, *[F.col(c).alias(c.removeprefix("f_")) for c in feature_columns()])


def save_analysis(analyses: DataFrame, path: str) -> None:
    """Stored analyses, partitioned by the version that produced them."""
    analyses.write.mode("append").partitionBy("analyzer_version").parquet(path)


def load_analysis(spark: SparkSession, path: str, analysis_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("analysis_id") == analysis_id)


def release(features: DataFrame, captures: DataFrame, included: DataFrame, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows of shipped captures in both tables, rows dropped, label distribution, and size and digest of every shipped file.

    ``files`` (capture, path, length, sha256) lists capture files as ``digests.file_digests`` finds them.
    """
    wanted = included.select("capture").distinct()
    rows = features.join(wanted, "capture", "left_semi")
    flagged = features.join(wanted.withColumn("shipped", F.lit(True)), "capture", "left")
    parts = {
        "session_features": rows,
        "captures": captures.join(wanted, "capture", "left_semi"),
        "totals": flagged.agg(F.count_if(F.col("shipped")).alias("kept"),
                              F.count_if(F.col("shipped").isNull()).alias("dropped")),
        "labels": rows.groupBy(F.coalesce("risk_label", F.lit("?")).alias("risk_label")).agg(F.count(F.lit(1)).alias("n")),
    }
    if files is not None:
        parts["files"] = files.join(wanted, "capture", "left_semi").select("capture", "path", "length", "sha256")
    return parts
