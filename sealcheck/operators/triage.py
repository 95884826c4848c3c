"""Triage model: labels, training rows, classifier, fallback, novelty."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sealcheck.operators import forest
from sealcheck.operators.features import feature_columns
from sealcheck.operators.forest import CLASSES
from sealcheck.operators.ranks import exact_percentiles, lowest_share
from sealcheck.operators.scoring import risk_band
from sealcheck.tables import (
    ALL_INSIDE, CAPTURE_SUFFIXES, FALLBACK_NOTE, FEATURES, LOAD_FAILED_NOTE, MODEL_VERSION, PREDICTION_NOTE, STALE_NOTE, RISK_BANDS, TRAINING_CAP, TRAINING_FOLDERS, TRAINING_REPEAT,
)


def _f(name: str) -> Column:
    return F.col(f"f_{name}")


def feature_risk_label(features: DataFrame) -> DataFrame:
    """Additive penalty score over the features and its band. Unknown costs nothing."""
    tls, cert = _f("tls_detected") != 0, _f("certificate_present") != 0
    version, strength, bits = _f("tls_version_rank"), _f("cipher_strength_score"), _f("certificate_key_bits")
    penalties = [
        (tls & (version <= 2), 45), (tls & (version == 3), 30),
        (tls & (strength <= 20), 45), (tls & (strength > 20) & (strength <= 55), 18),
        (_f("forward_secrecy") == 0, 18),
        (~tls & (F.col("protocol") != "UNKNOWN"), 35),
        (_f("plaintext_authentication") != 0, 45),
        (cert & (_f("certificate_expired") != 0), 30), (cert & (_f("certificate_self_signed") != 0), 18),
        (cert & (bits > 0) & (bits < 2048), 25), (cert & (_f("certificate_signature_strength") == 1), 18),
        (cert & (_f("hostname_match") == 0), 25), (cert & (_f("chain_complete") == 0), 12),
        (~cert & tls & (_f("handshake_complete") == 0), 4),
        (_f("handshake_failure_count") != 0, 12),
    ]
    score = F.lit(0)
    for condition, points in penalties:
        score = score + F.when(condition, points).otherwise(0)
    return features.select("*", score.alias("label_score"), risk_band(F.col("label_score")).alias("feature_label"))


# ------------------------------------------------------------------ training data
def is_training_path(path: Column, root: str = "") -> Column:
    """Captures directly inside one of the training folders below ``root``."""
    folders = "|".join(TRAINING_FOLDERS)
    endings = "|".join(s.lstrip(".") for s in CAPTURE_SUFFIXES if not s.endswith(".gz"))
    below = re.escape(root.rstrip("/") + "/") if root else ""
    return path.rlike(rf"^{below}(?:{folders})/[^/]+\.(?:{endings})$")


def training_rows(sessions: DataFrame, root: str = "", cap: int = TRAINING_CAP, repeat: int = TRAINING_REPEAT) -> DataFrame:
    """Sessions of training captures, the first ``cap`` of each, every row ``repeat`` times.

    ``row_number() <= cap`` is cut inside the tasks before the shuffle (window group limit).
    """
    order = W.partitionBy("capture").orderBy(F.coalesce("first_frame", F.lit(0)), "session_id")
    kept = (sessions.filter(is_training_path(F.col("path"), root))
            .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap).drop("place"))
    return kept.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(repeat))))


def stratified_split(rows: DataFrame, label: str, identity: list[str], share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train``; the digest of identity and seed decides, ``share`` of every label."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in identity], F.lit(str(seed))))
    return lowest_share(rows.withColumn("digest", digest), label, "digest", share) \
        .withColumnRenamed("chosen", "is_train").drop("digest")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c); the join side has one row per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    everything = W.partitionBy(F.lit(0))
    weights = counts.select(label, (F.sum("n_class").over(everything)
                                    / (F.count(F.lit(1)).over(everything) * F.col("n_class"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)


# ------------------------------------------------------------------ classifier
def fit_risk(rows: DataFrame, label: str = "label", trees: int = 220, seed: int = 42) -> forest.ForestModel:
    """Balanced random forest over the features, trees as deep as their rows allow."""
    grown = forest.grow(rows, label, trees, folds=False, seed=seed)
    return forest.ForestModel(grown.nodes, grown.cuts, trees)


def score_risk(features: DataFrame, model: forest.ForestModel) -> DataFrame:
    """Add ml_class and ml_confidence (percent, two decimals)."""
    found, confidence = forest.verdict(model.trees)
    return model.votes(features).select(*[F.col(f"`{c}`") for c in features.columns], found.alias("ml_class"), confidence.alias("ml_confidence"))


def schema_fingerprint() -> str:
    payload = json.dumps({"model_version": MODEL_VERSION, "features": list(FEATURES),
                          "risk_class_bands": RISK_BANDS}, sort_keys=True)
    return hashlib.sha256(payload.encode()).hexdigest()[:16]


def rule_fallback(scored: DataFrame, predictions: DataFrame | None = None, fingerprint: str | None = None, load_error: str | None = None) -> DataFrame:
    """Model class where a current model predicted one, the rule class everywhere else, which says why.

    ``load_error`` names what kept a saved model from being read, ``predictions.ml_error`` what kept a session from being predicted.
    Fallback rows have no confidence and no anomaly score and are not anomalous.
    """
    current = predictions is not None and not load_error and fingerprint == schema_fingerprint()
    if current:
        keys = ["capture", "session_id"]
        facts = [c for c in ("ml_confidence", "ml_anomaly_score", "ml_anomalous") if c in predictions.columns]
        failed = F.col("ml_error") if "ml_error" in predictions.columns else F.lit(None).cast("string")
        joined = scored.drop(*facts).join(predictions.select(*keys, F.col("ml_class").alias("predicted"), failed.alias("failed"), *facts), keys, "left")
    else:
        joined = scored.withColumns({"predicted": F.lit(None).cast("string"), "failed": F.lit(None).cast("string")})
    state = "load_failed" if load_error else "not_loaded" if predictions is None else MODEL_VERSION if current else "stale"
    why = {"load_failed": f" {LOAD_FAILED_NOTE}{load_error}", "stale": f" {STALE_NOTE}"}.get(state, "")
    note = F.lit(FALLBACK_NOTE + why)
    if current:
        note = F.concat(note, F.lit(f" {PREDICTION_NOTE}"), F.coalesce("failed", F.lit("no prediction")))
    return joined.select(
        "*", F.coalesce("predicted", "policy_risk_class").alias("ml_class"),
        F.when(F.col("predicted").isNotNull(), MODEL_VERSION).otherwise(f"rule-fallback ({state})").alias("ml_version"),
        F.when(F.col("predicted").isNull(), note).alias("ml_note"),
    ).drop("predicted", "failed")


def explanations(scored: DataFrame, limit: int = 5) -> DataFrame:
    """Up to five titles of findings above LOW."""
    serious = F.filter("findings", lambda f: ~f["severity"].isin("INFO", "LOW"))
    return scored.withColumn("ml_explanation", F.slice(F.transform(serious, lambda f: f["title"]), 1, limit))


# ------------------------------------------------------------------ model quality
def confusion(scored: DataFrame, expected: str = "policy_risk_class", predicted: str = "ml_class") -> DataFrame:
    return scored.groupBy(expected).pivot(predicted, list(CLASSES)).agg(F.count(F.lit(1))).na.fill(0)


def agreement(scored: DataFrame, *keys: str, expected: str = "policy_risk_class") -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ml_class") == F.col(expected)).alias("correct")
    ).withColumn("accuracy", F.bround(F.col("correct") / F.col("rows"), 4))


def leave_one_capture_out(rows: DataFrame, label: str = "label", trees: int = 120, base: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Hold out each training capture, fit on the others (and on ``base``), score it. All forests grow together."""
    grown = forest.grow(rows, label, trees, folds=True, base=base, seed=seed)
    return agreement(forest.held_out_classes(grown, trees), "capture", expected="label")


def transfer_test(source: DataFrame, target: DataFrame, label: str = "label", trees: int = 220, seed: int = 42) -> DataFrame:
    """Train on one source only, score the other, per capture."""
    return agreement(score_risk(target, fit_risk(source, label, trees, seed)), "capture", expected=label)


# ------------------------------------------------------------------ novelty
def _long_features(features: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), _f(n).alias("value")) for n in FEATURES])
    return features.select(F.explode(pairs).alias("p")).select("p.feature", "p.value")


def feature_ranges(features: DataFrame) -> DataFrame:
    """min, p01, p50, p99 and max per feature, linear interpolation."""
    names = {0.0: "min", 0.01: "p01", 0.5: "p50", 0.99: "p99", 1.0: "max"}
    cuts = exact_percentiles(_long_features(features), "feature", "value", list(names))
    return cuts.groupBy("feature").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("percentile"))).alias(n) for p, n in names.items()])


def collect_ranges(ranges: DataFrame) -> dict[str, tuple[float, float]]:
    """The p01/p99 pair per feature; at most 26 rows reach the driver."""
    return {r["feature"]: (r["p01"], r["p99"]) for r in ranges.select("feature", "p01", "p99").collect()}


def novelty_session(features: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Features outside the training range; two of them, or a tenth, make a session novel."""
    compared = [n for n in FEATURES if n in ranges]
    outside = F.array_compact(F.array(*[
        F.when((_f(n) < ranges[n][0]) | (_f(n) > ranges[n][1]), F.lit(n)) for n in compared]))
    threshold = max(2, len(compared) // 10)
    return features.select(
        "*", outside.alias("outside_features"), F.size("outside_features").alias("outside_count"),
        (F.col("outside_count") >= threshold).alias("novel"),
        F.when(F.col("novel"), "OUTSIDE TRAINING RANGE").otherwise("within training range").alias("novelty_verdict"),
        _novelty_sentence(len(compared)).alias("novelty_note"))


def _novelty_sentence(compared: int) -> Column:
    listed = F.concat(F.array_join(F.slice("outside_features", 1, 6), ", "),
                      F.when(F.col("outside_count") > 6, F.concat(F.lit(" (+"), F.col("outside_count") - 6, F.lit(" more)"))).otherwise(""))
    novel = F.concat(F.col("outside_count"), F.lit(f" of {compared} features are outside the training range: "), listed,
                     F.lit(". The ML class is not validated for this session - rely on the rule findings."))
    return (F.when(F.col("outside_count") == 0, ALL_INSIDE).when(F.col("novel"), novel)
            .otherwise(F.concat(F.lit("Features slightly outside the training range: "), listed, F.lit("."))))


def novelty_capture(checked: DataFrame) -> DataFrame:
    """Per capture: features outside anywhere in the order sessions show them, novel sessions, verdict and note."""
    place = F.struct(F.coalesce("first_frame", F.lit(0)), "session_id")
    flags = [F.min(F.when(F.array_contains("outside_features", n), place)).alias(f"out_{n}") for n in FEATURES]
    totals = checked.groupBy("capture").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("novel").alias("novel_sessions"), *flags)
    seen = F.array_compact(F.array(*[
        F.when(F.col(f"out_{n}").isNotNull(), F.struct(F.col(f"out_{n}").alias("first"), F.lit(i).alias("position"), F.lit(n).alias("name")))
        for i, n in enumerate(FEATURES)]))
    outside = F.transform(F.array_sort(seen), lambda s: s["name"])
    note = F.when(F.col("novel_sessions") > 0, F.concat(
        F.col("novel_sessions"), F.lit(" of "), F.col("sessions"),
        F.lit(" session(s) fall outside the training range. The rule findings still apply; "
              "treat the ML class as unvalidated here."))).otherwise(F.concat(
                  F.lit("All "), F.col("sessions"), F.lit(" session(s) are within the range the model was trained on.")))
    verdict = F.when(F.size("outside_features") >= max(2, len(FEATURES) // 10), "OUTSIDE TRAINING RANGE") \
               .otherwise("within training range")
    return totals.select("capture", "sessions", "novel_sessions", outside.alias("outside_features"),
                         verdict.alias("verdict"), note.alias("note"))


def model_freshness(files: DataFrame, model_time: Column, root: str = "") -> DataFrame:
    """Is the model at least as new (one second of grace) as every training capture?"""
    newest = files.filter(is_training_path(F.col("path"), root)).agg(
        F.max("modified_epoch").alias("newest"), F.max_by("path", "modified_epoch").alias("newest_path"))
    return newest.select("newest_path", "newest", model_time.alias("model_epoch"),
                         F.coalesce(F.col("newest") <= model_time + 1, F.lit(True)).alias("fresh"))


def training_frame(rows: DataFrame, label: str) -> DataFrame:
    """The columns a fit needs and nothing else."""
    return rows.select("capture", "session_id", *[c for c in ("copy_no",) if c in rows.columns],
                       F.col(label).alias("label"), *feature_columns())
