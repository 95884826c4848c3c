"""Look-ups in the ordered field list of one dissected packet.

``fields`` is ``ARRAY<STRUCT<key: STRING, value: STRING>>`` in document order with
normalised keys. Document order matters: the first match wins.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from sealcheck.tables import MAIL_PORTS

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def norm_key(key: Column) -> Column:
    return F.translate(F.lower(key), "_", ".")


def _key_has(needles):
    wanted = [n.lower().replace("_", ".") for n in needles]
    return lambda f: any_of(f["key"].contains(n) for n in wanted)


def has_key(fields: Column, *needles: str) -> Column:
    return F.exists(fields, _key_has(needles))


def field_values(fields: Column, *needles: str) -> Column:
    return F.transform(F.filter(fields, _key_has(needles)), lambda f: f["value"])


def field_first(fields: Column, *needles: str) -> Column:
    return F.try_element_at(field_values(fields, *needles), F.lit(1))


def to_double(value: Column) -> Column:
    return F.when(value.rlike(_NUMBER), F.trim(value).cast("double"))


def to_int(value: Column) -> Column:
    v = F.trim(value)
    radix = F.when(v.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(v, 3, 64), 16, 10)) \
             .when(v.rlike("^0[oO][0-7]+$"), F.conv(F.substring(v, 3, 64), 8, 10)) \
             .when(v.rlike("^0[bB][01]+$"), F.conv(F.substring(v, 3, 64), 2, 10))
    return F.coalesce(
        radix.cast("bigint"),
        F.when(v.rlike(r"^[+-]?\d{1,18}$"), v.cast("bigint")),
        to_double(value).cast("bigint"),
    )


def field_int(fields: Column, *needles: str) -> Column:
    return to_int(field_first(fields, *needles))


def field_float(fields: Column, *needles: str) -> Column:
    return to_double(field_first(fields, *needles))


def packet_time_us(fields: Column) -> Column:
    """Capture time in microseconds since the epoch, NULL when the export has none."""
    seconds = field_first(fields, "frame.time.epoch")
    exact = F.when(seconds.rlike(_NUMBER), F.trim(seconds).cast("decimal(28,9)"))
    return (exact * F.lit(1000000)).cast("bigint")


def relative_time(fields: Column) -> Column:
    return field_float(fields, "frame.time.relative")


def handshake_types(fields: Column) -> Column:
    parts = F.transform(field_values(fields, "handshake.type"), lambda v: F.split(F.lower(v), ","))
    trimmed = F.transform(F.flatten(parts), lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def _mail_key(f: Column) -> Column:
    return any_of(f["key"].contains(t) for t in ("smtp", "imap", "pop"))


def _content_key(f: Column) -> Column:
    return any_of(f["key"].contains(t) for t in ("data", "fragment", "reassembled", "body"))


def mail_text(fields: Column) -> Column:
    """Command and response values only; message content is never read."""
    kept = F.filter(fields, lambda f: _mail_key(f) & ~_content_key(f))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda f: f["value"]), "\n"))


def has_mail_layer(fields: Column) -> Column:
    return F.exists(fields, _mail_key)


def dissected_protocol(fields: Column) -> Column:
    return (F.when(has_key(fields, "smtp"), "SMTP")
            .when(has_key(fields, "imap"), "IMAP")
            .when(has_key(fields, "pop"), "POP3"))


def port_protocol(port: Column) -> Column:
    """Protocol of a standard mail port, else NULL."""
    by_protocol: dict[str, list[int]] = {}
    for number, protocol in MAIL_PORTS.items():
        by_protocol.setdefault(protocol, []).append(number)
    result = F.lit(None).cast("string")
    for protocol, numbers in by_protocol.items():
        result = F.when(port.isin(*numbers), protocol).otherwise(result)
    return result


def packet_protocol(fields: Column, src_port: Column, dst_port: Column) -> Column:
    return F.coalesce(dissected_protocol(fields), port_protocol(src_port), port_protocol(dst_port))


def ip_value(fields: Column, *needles: str) -> Column:
    value = field_first(fields, *needles)
    return F.when(~value.startswith("0x"), value)


def sni_value(fields: Column) -> Column:
    names = F.filter(
        field_values(fields, "extensions.server.name"),
        lambda v: v.contains(".") & ~v.rlike(r"^[0-9.]*[0-9][0-9.]*$"),
    )
    return F.try_element_at(names, F.lit(1))


def server_name(fields: Column) -> Column:
    """The first name a client asked for, whatever it looks like."""
    named = F.filter(fields, lambda f: f["key"].endswith("extensions.server.name") & (F.trim(f["value"]) != ""))
    return F.split(F.trim(F.try_element_at(named, F.lit(1))["value"]), ",")[0]


def certificate_values(fields: Column) -> Column:
    skipped = ("request", "status", "url", "authorities", "types")
    kept = F.filter(
        fields,
        lambda f: f["key"].contains("handshake.certificate")
        & ~any_of(f["key"].contains(t) for t in skipped),
    )
    return F.transform(kept, lambda f: f["value"])


def _searchable(fields: Column) -> Column:
    return F.array_join(F.transform(fields, lambda f: F.concat_ws(" ", f["key"], f["value"])), " ")


def tls_flags(fields: Column) -> Column:
    """STRUCT of is_tls, client_hello, server_hello, alert and failure."""
    types = handshake_types(fields)
    is_tls = has_key(fields, "tls", "ssl")
    text = _searchable(fields)
    client = F.arrays_overlap(types, F.array(*map(F.lit, ("1", "client hello", "client.hello")))) \
        | text.rlike("(?i)client.?hello")
    server = F.arrays_overlap(types, F.array(*map(F.lit, ("2", "server hello", "server.hello")))) \
        | text.rlike("(?i)server.?hello")
    return F.struct(
        is_tls.alias("is_tls"),
        (is_tls & client).alias("client_hello"),
        (is_tls & server).alias("server_hello"),
        (is_tls & has_key(fields, "alert")).alias("alert"),
        (is_tls & text.rlike("(?i)handshake.failure|fatal")).alias("failure"),
    )


def is_retransmission(fields: Column) -> Column:
    return has_key(fields, "retransmission")


def frame_length(fields: Column) -> Column:
    return F.greatest(F.coalesce(field_int(fields, "frame.len", "tcp.len"), F.lit(0)), F.lit(0))
