"""TLS version names, cipher suites and certificate predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sealcheck.functions.fields import field_values
from sealcheck.tables import (
    CIPHER_NAME_HINTS, CIPHER_SUITES, KEY_EXCHANGE_CODE, SIGNALLING_SUITES, TLS_VERSIONS,
)

_CODE = r"^\s*(?:0x)?([0-9a-fA-F]{4})(?:\s*\(.*\))?\s*$"
_NO_SECRECY_CLAIM = ("NULL", "ANON", "PSK")


def tls_version_name(value: Column) -> Column:
    text = F.lower(F.trim(value))

    def reads(word: str, *codes: str) -> Column:
        return text.contains(word) | text.isin(*codes)

    return (F.when(reads("1.3", "0x0304", "772"), "TLS 1.3")
            .when(reads("1.2", "0x0303", "771"), "TLS 1.2")
            .when(reads("1.1", "0x0302", "770"), "TLS 1.1")
            .when(reads("1.0", "0x0301", "769"), "TLS 1.0")
            .when(reads("ssl", "0x0300", "768"), "SSLv3"))


def version_rank(name: Column) -> Column:
    """1..5 for a known version, 0 otherwise."""
    known = F.array(*map(F.lit, TLS_VERSIONS))
    return F.coalesce(F.array_position(known, name), F.lit(0)).cast("int")


def version_mask(names: Column) -> Column:
    """Set of versions as bits, so that sets merge with ``bit_or``."""
    mask = F.lit(0)
    for position, name in enumerate(TLS_VERSIONS):
        mask = mask + F.when(F.array_contains(names, name), 1 << position).otherwise(0)
    return F.coalesce(mask, F.lit(0))


def mask_versions(mask: Column) -> Column:
    """Names of the set bits, lowest rank first."""
    return F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(TLS_VERSIONS)
    ]))


def mask_highest(mask: Column) -> Column:
    result = F.lit(None).cast("string")
    for position, name in enumerate(TLS_VERSIONS):
        result = F.when(mask >= (1 << position), name).otherwise(result)
    return result


def handshake_versions(fields: Column) -> Column:
    values = field_values(
        fields, "handshake.extensions.supported.version", "handshake.supported.version", "handshake.version")
    return F.array_compact(F.transform(values, tls_version_name))


def cipher_code(value: Column) -> Column:
    """Canonical ``0xXXXX`` of a code-like value, else NULL."""
    digits = F.regexp_extract(value, _CODE, 1)
    return F.when(digits != "", F.concat(F.lit("0x"), F.lower(digits)))


def is_cipher_value(value: Column) -> Column:
    return value.rlike(_CODE) | F.upper(value).rlike("TLS_|SSL_|_WITH_")


def cipher_values(fields: Column) -> Column:
    return F.filter(field_values(fields, "handshake.ciphersuite"), is_cipher_value)


def is_signalling(value: Column) -> Column:
    """Renegotiation/fallback markers and GREASE placeholders are no real suites."""
    number = F.conv(F.regexp_extract(value, _CODE, 1), 16, 10).cast("int")
    high, low = F.shiftright(number, 8), number.bitwiseAND(F.lit(255))
    grease = (high == low) & (high.bitwiseAND(F.lit(15)) == 10)
    return F.coalesce(number.isin(*SIGNALLING_SUITES) | grease, F.lit(False))


def _suite_facts(code: Column) -> Column:
    """STRUCT(name, key_exchange, strength) of a known code: one constant map, one look-up."""
    entries = ", ".join(
        f"'{suite}', named_struct('name', '{name}', 'key_exchange', '{kx}', 'strength', {strength})"
        for suite, (name, kx, strength) in CIPHER_SUITES.items())
    return F.try_element_at(F.expr(f"map({entries})"), code)


def _secrecy(key_exchange: Column) -> Column:
    return F.when(~key_exchange.isin(*_NO_SECRECY_CLAIM), key_exchange != "RSA")


def cipher_profile(value: Column) -> Column:
    """STRUCT of code, name, display, key_exchange, forward_secrecy, strength, known.

    Unknown codes stay unknown; readable names are described by the words in them.
    """
    code = cipher_code(value)
    facts = _suite_facts(code)
    table_name, table_kx, table_strength = facts["name"], facts["key_exchange"], facts["strength"]

    text = F.upper(value)
    direct = (F.when(text.rlike("ECDHE|ECDH_|X25519"), "ECDHE")
              .when(text.rlike("DHE|DH_"), "DHE")
              .when(text.contains("RSA"), "RSA"))
    hint_kx, hint_strength = F.lit(None).cast("string"), F.lit(50)
    for word, kx, strength in reversed(CIPHER_NAME_HINTS):
        hit = text.contains(word)
        hint_kx = F.when(hit, kx).otherwise(hint_kx)
        hint_strength = F.when(hit, strength).otherwise(hint_strength)
    tls13 = text.rlike("TLS_AES_|TLS_CHACHA20")
    named_kx = F.when(tls13, "TLS 1.3 ephemeral").otherwise(F.coalesce(direct, hint_kx))
    named_strength = F.when(tls13, 90).when(named_kx.isNull(), 50).otherwise(hint_strength)

    by_name = code.isNull() & (value != "")
    name = F.when(by_name, value).otherwise(table_name)
    kx = F.when(by_name, named_kx).otherwise(table_kx)
    strength = F.when(by_name, named_strength).otherwise(table_strength)
    display = F.when(table_name.isNotNull(), F.concat(table_name, F.lit(" ("), code, F.lit(")"))).otherwise(value)
    return F.struct(
        code.alias("code"),
        name.alias("name"),
        F.when(value != "", display).alias("display"),
        kx.alias("key_exchange"),
        _secrecy(kx).alias("forward_secrecy"),
        F.coalesce(strength, F.lit(0)).alias("strength"),
        F.coalesce(name.isNotNull(), F.lit(False)).alias("known"),
    )


def cipher_display(value: Column) -> Column:
    code = cipher_code(value)
    name = _suite_facts(code)["name"]
    return F.coalesce(F.concat(name, F.lit(" ("), code, F.lit(")")), value)


def key_exchange_code(key_exchange: Column) -> Column:
    result = F.lit(0)
    for name, number in KEY_EXCHANGE_CODE.items():
        result = F.when(key_exchange == name, number).otherwise(result)
    return result


# ------------------------------------------------------------------ certificates
_SEPARATORS = ": \t\n\r\f\u000b"


def certificate_candidates(values: Column) -> Column:
    """Fingerprints of all values that can be DER certificates, in order.

    At least 100 hex digits, an even number of them, starting with the SEQUENCE tag 30.
    Other characters than digits and separators leave nothing after ``unhex``.
    """
    cleaned = F.filter(F.transform(values, lambda v: F.translate(v, _SEPARATORS, "")),
                       lambda h: (F.length(h) >= 100) & h.startswith("30") & (F.length(h) % 2 == 0))
    return F.array_compact(F.transform(cleaned, lambda h: F.sha2(F.unhex(h), 256)))


def _host(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(value), r"\.+$", ""))


def matches_dns_name(pattern: Column, hostname: Column) -> Column:
    """One certificate name against a host; a wildcard covers the left-most label only."""
    p, h = _host(pattern), _host(hostname)
    head, tail = F.substring_index(h, ".", 1), _tail(h)
    wildcard = p.startswith("*.") & (head != "") & (tail != "") & (p == F.concat(F.lit("*."), tail))
    return F.coalesce((p != "") & (h != "") & ((p == h) | wildcard), F.lit(False))


def _tail(host: Column) -> Column:
    """Everything after the first dot."""
    return F.regexp_extract(host, r"^[^.]*\.(.*)$", 1)


def hostname_match(sans: Column, common_name: Column, sni: Column) -> Column:
    """NULL without SNI; alternative names are authoritative, the CN only without any."""
    names = F.filter(F.coalesce(sans, F.array().cast("array<string>")), lambda v: v != "")
    by_san = F.exists(names, lambda v: matches_dns_name(v, sni))
    by_cn = F.coalesce((common_name != "") & matches_dns_name(common_name, sni), F.lit(False))
    usable = sni.contains(".") | sni.contains(":")
    return F.when(sni != "", F.when(~usable, False).when(F.size(names) > 0, by_san).otherwise(by_cn))
