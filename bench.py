"""Headline timings: sessions per second from typed packets to findings and summaries.

Typed packets and certificates are derived from the driver's tables and written once
(not timed) in as many files as there are CPUs, as an export job would leave them. Every query is then read from Parquet,
run once to warm the JVM and timed on the second run.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from pyspark.sql import functions as F

    from checks import views
    from sealcheck.operators import discovery, evaluation, rules, scoring, sessions, triage
    from sealcheck.plans import posture
    from sealcheck.session import build_session

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    work = tempfile.mkdtemp(prefix="bench-")
    views.typed_packets(spark, SF_DIR).repartition(int(CPUS)).write.parquet(f"{work}/packets")
    views.typed_packets(spark, SF_DIR, hints=False).repartition(int(CPUS)).write.parquet(f"{work}/unhinted")
    views.certificate_dimension(spark, SF_DIR).write.parquet(f"{work}/certs")
    packets, unhinted = spark.read.parquet(f"{work}/packets"), spark.read.parquet(f"{work}/unhinted")
    certs = spark.read.parquet(f"{work}/certs")
    posture.scored_sessions(packets, certs, views.AS_OF_EPOCH).write.parquet(f"{work}/scored")
    scored = triage.feature_risk_label(spark.read.parquet(f"{work}/scored")).withColumnRenamed("feature_label", "ml_class")

    queries = {
        "sessionise": lambda: sessions.sessionise(packets),
        "packets_to_summary": lambda: scoring.capture_summary(posture.scored_sessions(packets, certs, views.AS_OF_EPOCH)),
        "packets_to_findings": lambda: rules.finding_rows(posture.scored_sessions(packets, certs, views.AS_OF_EPOCH)),
        "discover_ports": lambda: discovery.discovered_ports(unhinted),
        "unclassified_tls": lambda: discovery.unclassified_tls(unhinted),
        "rules_and_scores": lambda: scoring.score_sessions(rules.assess_sessions(
            spark.read.parquet(f"{work}/scored").drop("findings", "policy_risk_score", "posture_score", "policy_risk_class",
                                                      "evidence_completeness"))),
        "capture_summary": lambda: scoring.capture_summary(scored),
        "top_findings": lambda: scoring.top_findings(scored),
        "feature_ranges": lambda: triage.feature_ranges(scored),
        "one_capture_summary": lambda: scoring.capture_summary(posture.scored_sessions(      # all sessions in one capture
            packets.withColumn("capture", F.lit("all")), certs, views.AS_OF_EPOCH)),
        "replicate_10x_summary": lambda: scoring.capture_summary(posture.scored_sessions(
            evaluation.replicate_shift(packets, 10, 900).drop("copy_no"), certs, views.AS_OF_EPOCH)),
    }
    seconds, planning = {}, {}
    for name, build in queries.items():
        for _ in range(2):
            started = time.time()
            plan = build()
            planning[name] = round(time.time() - started, 3)
            plan.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - started, 3)
    n_sessions = scored.count()
    print(json.dumps({
        "metric": "packets_to_summary", "value": seconds["packets_to_summary"], "unit": "sec", "queries": seconds, "plan_building": planning,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "sessions": n_sessions,
        "sessions_per_sec": round(n_sessions / seconds["packets_to_summary"], 1),
        "sessions_per_sec_10x": round(10 * n_sessions / seconds["replicate_10x_summary"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
