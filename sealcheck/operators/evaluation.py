"""Scoring against declared expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealcheck.operators.ranks import place_in_group
from sealcheck.tables import (
    CLEARTEXT_FORBIDDEN, CLEARTEXT_MODES, IMPLICIT_FORBIDDEN, IMPLICIT_MODE, PROFILES, REJECTED_MODES, RULES, SWEEP_PORTS,
    UPGRADE_FORBIDDEN, UPGRADE_MODES,
)

CHECKS = ("matched", "findings", "forbidden", "facts", "class")
RUN = 1_000_000
PAIR = ["capture", "protocol", "server_port", "client_port"]


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


# ------------------------------------------------------------------ declarations
def profile_dimension(spark: SparkSession) -> DataFrame:
    rows = [(name, version, secrecy, cert, expect, forbid)
            for name, (version, secrecy, cert, expect, forbid) in PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, profile_version string, profile_secrecy boolean, "
                                       "profile_cert boolean, profile_expect array<string>, profile_forbid array<string>")


def declare_expectation(declared: DataFrame) -> DataFrame:
    """Expected and forbidden findings, facts and class from (mode, profile) alone.

    The seven profiles are a fixed dimension, so that join side is always broadcast.
    """
    df = declared.join(F.broadcast(profile_dimension(declared.sparkSession)), "profile", "left")
    mode, profiled = F.col("mode"), F.col("profile_version").isNotNull()
    clear, rejected = mode.isin(*CLEARTEXT_MODES), mode.isin(*REJECTED_MODES)
    nothing = F.array().cast("array<string>")
    expect = F.concat(
        F.when(rejected, _texts(["STARTTLS_REJECTED"])).otherwise(nothing),
        F.when(clear, _texts(["PLAINTEXT_AUTHENTICATION"])).otherwise(nothing),
        F.coalesce("profile_expect", nothing))
    forbid = F.concat(
        F.when(mode == IMPLICIT_MODE, _texts(IMPLICIT_FORBIDDEN)).when(mode.isin(*UPGRADE_MODES), _texts(UPGRADE_FORBIDDEN))
         .when(clear, _texts(CLEARTEXT_FORBIDDEN)).otherwise(nothing),
        F.coalesce("profile_forbid", nothing))
    profile = F.col("profile")
    facts = F.struct(
        F.lit(True).alias("checks_version"), F.col("profile_version").alias("tls_version"),
        F.lit(True).alias("checks_cert"), F.coalesce("profile_cert", F.lit(False)).alias("cert_observed"),
        F.col("profile_secrecy").isNotNull().alias("checks_secrecy"), F.col("profile_secrecy").alias("forward_secrecy"))
    exact = F.when(clear, "CRITICAL").when(profile.isin("modern", "modern-tls13"), "LOW")
    band = F.when(exact.isNull() & profiled, F.when(
        profile.isin("legacy-tls10", "weak-cert", "null-cipher"), _texts(["HIGH", "CRITICAL"])
    ).otherwise(_texts(["MEDIUM", "HIGH"])))
    return df.select(*declared.columns, (mode == IMPLICIT_MODE).alias("implicit_tls"),
                     F.array_distinct(expect).alias("expect_findings"), F.array_distinct(forbid).alias("forbid_findings"),
                     exact.alias("class_exact"), band.alias("class_band"), facts.alias("facts"))


def coverage_matrix(spark: SparkSession, observed: DataFrame) -> DataFrame:
    """The protocol x port x profile plan, with how many sessions were observed per cell."""
    ports = [(protocol, port) for protocol, pair in SWEEP_PORTS.items() for port in pair]
    plan = spark.createDataFrame(ports, "protocol string, port int").select(
        "protocol", "port", F.explode(_texts(list(PROFILES))).alias("profile"))
    plan = plan.select("*", F.lit(IMPLICIT_MODE).alias("mode"),
                       F.concat(F.lower("protocol"), F.lit("-"), "profile", F.lit("-port"), "port").alias("name"))
    expected = plan.join(F.broadcast(profile_dimension(spark)), "profile")
    seen = observed.groupBy(F.col("server_port").alias("port"), "profile").agg(F.count(F.lit(1)).alias("observed"))
    return expected.join(seen, ["port", "profile"], "left").select(
        "name", "protocol", "port", "mode", "profile", F.col("profile_expect").alias("expect_findings"),
        F.col("profile_forbid").alias("forbid_findings"), F.coalesce("observed", F.lit(0)).alias("observed"))


# ------------------------------------------------------------------ matching
def match_expected(expected: DataFrame, sessions: DataFrame) -> DataFrame:
    """Pair the k-th expected session with the k-th actual one of the same addresses.

    Expected sessions follow entry by entry (``entry_no`` where it is declared, else mode and profile) and round by round
    within an entry.

    The k-th place is counted in runs of rounds and frames, so one address pair may hold any
    share of the sessions.
    """
    rounds = expected.withColumn("round", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("rounds", F.lit(1)), F.lit(1)))))
    entry = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c != "entry_no" else F.col(c)
             for c in ("entry_no", "mode", "profile") if c in expected.columns]
    run = F.struct(*entry, F.floor(F.col("round") / RUN).alias("round_run"))
    left = place_in_group(rounds, PAIR, [*entry, "round"], run, "pair_no")
    frame = F.coalesce("first_frame", F.lit(0))
    placed = place_in_group(sessions, PAIR, [frame, "session_id"], F.floor(frame / RUN), "pair_no")
    right = placed.select(
        *[F.col(c).alias(f"a_{c}") for c in PAIR], F.col("pair_no").alias("a_pair_no"),
        F.struct(*[c for c in sessions.columns if c not in ("capture",)]).alias("actual"))
    same = (F.col("capture") == F.col("a_capture")) & (F.col("pair_no") == F.col("a_pair_no"))
    for column in PAIR[1:]:
        same = same & F.col(column).eqNullSafe(F.col(f"a_{column}"))
    return left.join(right, same, "left").drop("a_pair_no", *[f"a_{c}" for c in PAIR])


def _observed() -> Column:
    return F.array_distinct(F.col("actual.findings.code"))


def check_findings(matched: DataFrame) -> DataFrame:
    return matched.select(
        "*", F.array_sort(F.array_except("expect_findings", _observed())).alias("missing_findings"),
        F.array_sort(F.array_intersect("forbid_findings", _observed())).alias("violations"))


def check_facts(matched: DataFrame) -> DataFrame:
    """Version, certificate and secrecy against the declaration; unchecked facts pass."""
    tls = F.col("actual.tls_detected")
    version = F.when(tls, F.col("actual.tls_version"))
    secrecy = F.when(tls, F.col("actual.forward_secrecy"))
    cert = F.coalesce("actual.cert_present", F.lit(False))
    facts = F.col("facts")
    return matched.select(
        "*",
        (~facts["checks_version"] | version.eqNullSafe(facts["tls_version"])).alias("version_ok"),
        (~facts["checks_cert"] | (cert == F.coalesce(facts["cert_observed"], F.lit(False)))).alias("cert_ok"),
        (~facts["checks_secrecy"] | secrecy.eqNullSafe(facts["forward_secrecy"])).alias("secrecy_ok"))


def check_class(matched: DataFrame) -> DataFrame:
    actual = F.col("actual.policy_risk_class")
    return matched.withColumn("class_ok", F.when(F.col("class_exact").isNotNull(), actual == F.col("class_exact"))
                              .when(F.size("class_band") > 0, F.array_contains("class_band", actual)).otherwise(True))


def score_expectations(expected: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per expected session with the five checks."""
    rows = check_class(check_facts(check_findings(match_expected(expected, sessions))))
    found = F.col("actual").isNotNull()

    def passed(condition: Column) -> Column:
        return found & F.coalesce(condition, F.lit(False))

    return rows.select(
        "*", found.alias("ok_matched"), passed(F.size("missing_findings") == 0).alias("ok_findings"),
        passed(F.size("violations") == 0).alias("ok_forbidden"),
        passed(F.col("version_ok") & F.col("cert_ok") & F.col("secrecy_ok")).alias("ok_facts"),
        passed(F.col("class_ok")).alias("ok_class"),
        F.when(found, F.col("actual.ml_class") == F.col("actual.policy_risk_class")).alias("ml_agrees"),
        (~F.coalesce("seen_in_training", F.lit(False))).alias("unseen"))


# ------------------------------------------------------------------ reports
def score_summary(scored: DataFrame) -> DataFrame:
    """Passes over all, unseen, non-repeated and repeated sessions in one aggregate."""
    subsets = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("unseen"), "unseen"),
        F.when(F.col("group") == "large", "scale").otherwise("distinct")))
    situation = F.struct("protocol", "server_port", "mode", "profile")
    return scored.withColumn("subset", F.explode(subsets)).groupBy("subset").agg(
        F.count(F.lit(1)).alias("sessions"), *[F.count_if(f"ok_{c}").alias(c) for c in CHECKS],
        F.count_if("ml_agrees").alias("ml_agree"), F.count("ml_agrees").alias("ml_compared"),
        F.count_distinct(situation).alias("situations"))


def per_capture_checks(scored: DataFrame) -> DataFrame:
    return scored.groupBy("capture", "group").agg(
        F.count(F.lit(1)).alias("sessions"), *[F.count_if(f"ok_{c}").alias(c) for c in CHECKS])


def observed_per_situation(scored: DataFrame) -> DataFrame:
    """What was reported first for each situation, and how often it was seen."""
    place = F.struct("capture", F.col("pair_no"), F.coalesce("client_port", F.lit(0)))
    first = F.min_by(F.struct(
        F.col("actual.tls_version").alias("tls_version"), F.col("actual.cipher_suite").alias("cipher_suite"),
        F.col("actual.cert_present").alias("cert_observed"),
        F.when(F.col("actual.tls_detected"), F.col("actual.forward_secrecy")).alias("forward_secrecy"),
        F.array_join(F.array_sort(_observed()), ", ").alias("findings"),
        F.col("actual.policy_risk_class").alias("rules_class"), F.col("actual.ml_class").alias("ml_class")), place)
    rows = scored.filter((F.col("group") != "large") & F.col("ok_matched"))
    return (rows.groupBy("protocol", "server_port", "mode", "profile").agg(first.alias("first"), F.count(F.lit(1)).alias("seen"))
            .select("protocol", "server_port", "mode", "profile", "first.*", "seen")
            .orderBy("protocol", "server_port", "mode", "profile"))


def ml_disagreements(scored: DataFrame) -> DataFrame:
    return (scored.filter(~F.col("ml_agrees"))
            .groupBy("protocol", "server_port", "mode", "profile", F.col("actual.policy_risk_class").alias("rules_class"),
                     F.col("actual.ml_class").alias("ml_class"))
            .agg(F.count(F.lit(1)).alias("sessions"))
            .orderBy(F.desc("sessions"), "protocol", "server_port", "mode", "profile"))


def failed_expectations(scored: DataFrame) -> DataFrame:
    failed = F.array_compact(F.array(*[F.when(~F.col(f"ok_{c}"), F.lit(c)) for c in CHECKS]))

    def listed(label: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(label), F.array_join(column, ", ")))

    def wrong(flag: str, label: str, expected: Column, got: Column) -> Column:
        return F.when(~F.col(flag), F.concat(F.lit(label), F.coalesce(expected, F.lit("None")), F.lit(", got "),
                                             F.coalesce(got, F.lit("None"))))

    wanted = F.coalesce("class_exact", F.array_join("class_band", "/"))
    detail = F.when(~F.col("ok_matched"), "no session matched these addresses in the capture").otherwise(F.concat_ws(
        "; ", listed("missing findings: ", "missing_findings"), listed("invented findings: ", "violations"),
        wrong("version_ok", "tls_version: expected ", F.col("facts.tls_version"), F.col("actual.tls_version")),
        wrong("class_ok", "class: expected ", wanted, F.col("actual.policy_risk_class"))))
    return scored.filter(F.size(failed) > 0).select(
        "capture", "protocol", "server_port", "client_port", "mode", "profile", "round",
        F.array_join(failed, ", ").alias("failed"), detail.alias("detail"))


def _capture_outcome(sessions: DataFrame) -> DataFrame:
    """Worst session, agreement and observed codes per capture in one aggregate."""
    place = F.struct(F.col("policy_risk_score").alias("score"), (-F.coalesce("first_frame", F.lit(0))).alias("earlier"), "session_id")
    novel = F.count_if("novel") if "novel" in sessions.columns else F.max(F.lit(0).cast("bigint"))
    codes = sorted(rule[0] for rule in RULES)
    seen = [F.bool_or(F.array_contains("findings.code", c)).alias(f"saw_{c}") for c in codes]
    rows = sessions.groupBy("capture").agg(
        F.count(F.lit(1)).alias("sessions"), F.max_by("policy_risk_class", place).alias("rules_class"),
        F.max_by("posture_score", place).alias("posture"), F.max_by("ml_class", place).alias("ml_class"),
        F.count_if(F.col("ml_class") == F.col("policy_risk_class")).alias("agree"), novel.alias("novel_sessions"), *seen)
    observed = F.array_compact(F.array(*[F.when(F.col(f"saw_{c}"), F.lit(c)) for c in codes]))
    return rows.select("*", observed.alias("observed")).drop(*[f"saw_{c}" for c in codes])


def scenario_outcome(captures: DataFrame, scenarios: DataFrame, sessions: DataFrame) -> DataFrame:
    """Captures with their scenario, observed codes, missing and forbidden ones."""
    nothing = F.array().cast("array<string>")
    return (captures.join(F.broadcast(scenarios), "scenario", "left")      # scenarios: a hand-written list
            .join(_capture_outcome(sessions), "capture", "left")
            .withColumns({"observed": F.coalesce("observed", nothing), "sessions": F.coalesce("sessions", F.lit(0))})
            .withColumns({
                "missing": F.array_sort(F.array_except(F.coalesce("expect_findings", nothing), "observed")),
                "forbidden_seen": F.array_sort(F.array_intersect(F.coalesce("forbid_findings", nothing), "observed"))}))


def split_variant(name: Column) -> Column:
    """STRUCT(scenario, port): ``x-port9993`` is scenario x moved to port 9993."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    port = F.regexp_extract(stem, r"-port(\d+)$", 1)
    return F.struct(F.regexp_replace(stem, r"-port\d+$", "").alias("scenario"),
                    F.when(port != "", port.cast("int")).alias("port"))


def capability_verdict(captures: DataFrame, scenarios: DataFrame, sessions: DataFrame, unclassified: DataFrame) -> DataFrame:
    """PASS, FAIL or UNCLASSIFIED per capture of relocated scenarios."""
    named = captures.withColumn("variant", split_variant(F.col("file"))) \
        .select("capture", "file", "variant.scenario", "variant.port")
    streams = unclassified.groupBy("capture").agg(F.count(F.lit(1)).alias("streams"))
    rows = scenario_outcome(named, scenarios, sessions).join(streams, "capture", "left")
    clean = (F.size("missing") == 0) & (F.size("forbidden_seen") == 0)
    verdict = F.when(F.col("sessions") > 0, F.when(clean, "PASS").otherwise("FAIL")) \
               .when(F.col("streams") > 0, "UNCLASSIFIED").otherwise("FAIL")
    return rows.select("capture", "scenario", "port", "sessions", "rules_class", "ml_class", "agree", "novel_sessions",
                       "observed", "missing", "forbidden_seen", verdict.alias("verdict"))


def scenario_verify(captures: DataFrame, scenarios: DataFrame, sessions: DataFrame) -> DataFrame:
    rows = scenario_outcome(captures, scenarios, sessions)
    good = (F.col("sessions") > 0) & (F.size("missing") == 0) & (F.size("forbidden_seen") == 0)
    return rows.select("capture", "scenario", "sessions", "missing", "forbidden_seen",
                       F.coalesce("rules_class", F.lit("NONE")).alias("worst_class"), "posture",
                       F.when(good, "OK").otherwise("CHECK").alias("status"))


def finding_coverage(sessions: DataFrame) -> DataFrame:
    """In how many captures each finding code occurs."""
    return (sessions.select("capture", F.explode("findings.code").alias("code")).distinct()
            .groupBy("code").agg(F.count(F.lit(1)).alias("captures")).orderBy(F.desc("captures"), "code"))


def heldout_leaks(training: DataFrame, heldout: DataFrame) -> DataFrame:
    """Training paths that belong to the held-out set; must be empty."""
    return training.join(heldout.select("path"), "path", "left_semi")


def undeclared_sessions(expected: DataFrame) -> DataFrame:
    """Declared sessions that expect nothing at all; must be empty."""
    return expected.filter((F.size("expect_findings") == 0) & (F.size("forbid_findings") == 0) & F.col("class_exact").isNull()
                           & (F.coalesce(F.size("class_band"), F.lit(0)) <= 0) & F.col("facts").isNull())


def replicate_shift(packets: DataFrame, times: int, shift_s: int) -> DataFrame:
    """The packet table ``times`` times, shifted in time, under new stream ids."""
    copies = packets.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    changed = {
        "ts_us": F.col("ts_us") + F.col("copy_no").cast("bigint") * F.lit(shift_s * 1_000_000),
        "stream_id": F.concat("stream_id", F.lit("-"), "copy_no"),
    }
    return copies.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in packets.columns], "copy_no")
