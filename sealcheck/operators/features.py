"""The 26 numeric session features; unknown evidence is coded -1 or 0, never a weakness."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.functions import tls
from sealcheck.tables import FEATURES


def _tri(flag: str) -> Column:
    return F.coalesce(F.col(flag).cast("int"), F.lit(-1))


def _one(flag: str) -> Column:
    return F.coalesce(F.col(flag).cast("int"), F.lit(0))


def session_features(sessions: DataFrame) -> DataFrame:
    """Add one ``f_*`` column per feature."""
    packets = F.col("packet_count")
    values = {
        "server_port": F.coalesce("server_port", F.lit(0)),
        "packet_count": packets,
        "byte_count": F.col("byte_count"),
        "duration_ms": F.col("duration_ms"),
        "retransmission_rate": F.col("retransmission_count") / F.greatest(packets, F.lit(1)),
        "handshake_failure_count": F.col("handshake_failures"),
        "tls_detected": _one("tls_detected"),
        "tls_version_rank": tls.version_rank(F.col("tls_version")),
        "cipher_strength_score": F.col("cipher_strength"),
        "key_exchange_code": tls.key_exchange_code(F.col("key_exchange")),
        "forward_secrecy": _tri("forward_secrecy"),
        "starttls_advertised": _one("starttls_advertised"),
        "starttls_success": _one("upgrade_successful"),
        "plaintext_authentication": _one("plaintext_auth"),
        "certificate_present": _one("cert_present"),
        "certificate_expired": _one("cert_expired"),
        "certificate_self_signed": _one("cert_self_signed"),
        "certificate_key_bits": F.coalesce("cert_key_bits", F.lit(0)),
        "certificate_signature_strength": F.when(F.col("cert_weak_signature"), 1)
                                           .when(F.col("cert_present"), 3).otherwise(0),
        "hostname_match": _tri("cert_hostname_match"),
        "chain_complete": _tri("cert_chain_complete"),
        "sni_present": (F.coalesce("sni", F.lit("")) != "").cast("int"),
        "handshake_complete": _one("handshake_complete"),
        "repeated_client_hellos": F.col("repeated_client_hellos"),
        "cipher_rarity": F.lit(0.0),
        "certificate_changed": F.lit(0),
    }
    return sessions.withColumns({f"f_{name}": values[name].cast("double") for name in FEATURES})


def feature_columns() -> list[str]:
    return [f"f_{name}" for name in FEATURES]


def with_vector(features: DataFrame, column: str = "vector") -> DataFrame:
    return VectorAssembler(inputCols=feature_columns(), outputCol=column).transform(features)
