"""What one chunk of mail dialogue says: upgrade requests, answers, credentials."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sealcheck.functions.fields import any_of
from sealcheck.tables import CAPABILITY_WORDS, MAIL_VOCABULARY, PAYLOAD_TOKENS, SERVER_GREETINGS

_LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def flat_text(text: Column) -> Column:
    """Whitespace runs collapsed to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def text_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, _LINE_BREAKS), lambda v: F.regexp_replace(v, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.filter(lines, lambda v: v != "")


def is_capability_line(line: Column) -> Column:
    upper = F.upper(line)
    return any_of(upper.contains(word) for word in CAPABILITY_WORDS)


def untagged_verdict(line: Column) -> Column:
    code = F.regexp_extract(line, r"^(\d{3})[ -]", 1)
    number = F.when(code != "", code.cast("int"))
    return (F.when(is_capability_line(line), None)
            .when(line.rlike(r"(?iU)^\+OK\b"), "positive")
            .when(line.rlike(r"(?iU)^-ERR\b"), "negative")
            .when(number.between(200, 299), "positive")
            .when(number >= 400, "negative")
            .when(number.isNotNull(), None)
            .when(line.rlike(r"(?iU)^\S{1,16} +OK\b"), "positive")
            .when(line.rlike(r"(?iU)^\S{1,16} +(?:NO|BAD|BYE)\b"), "negative"))


def tagged_answer(line: Column) -> Column:
    """STRUCT(tag, verdict) of a ``tag OK|NO|BAD|BYE`` line, NULL for any other line."""
    ok = F.regexp_extract(line, r"(?iU)^(\S{1,16}) +OK\b", 1)
    refused = F.regexp_extract(line, r"(?iU)^(\S{1,16}) +(?:NO|BAD|BYE)\b", 1)
    answer = F.when(ok != "", F.struct(F.lower(ok).alias("tag"), F.lit("positive").alias("verdict"))) \
              .when(refused != "", F.struct(F.lower(refused).alias("tag"), F.lit("negative").alias("verdict")))
    return F.when(~is_capability_line(line), answer)


def upgrade_verdict(line: Column, tag: Column) -> Column:
    """'positive', 'negative' or NULL for one line answering an upgrade request."""
    stripped = F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    answer = tagged_answer(stripped)
    tagged = F.when(answer["tag"] == F.lower(tag), answer["verdict"])
    return F.when(F.coalesce(tag, F.lit("")) != "", tagged).otherwise(untagged_verdict(stripped))


def first_untagged_verdict(text: Column) -> Column:
    verdicts = F.array_compact(F.transform(text_lines(text), untagged_verdict))
    return F.try_element_at(verdicts, F.lit(1))


def tagged_answers(text: Column) -> Column:
    return F.array_compact(F.transform(text_lines(text), tagged_answer))


def clear_auth(text: Column, protocol: Column) -> Column:
    flat = flat_text(text)
    smtp = flat.rlike(r"(?iU)\bAUTH(?:ENTICATE)?[ ]+(?:PLAIN|LOGIN|NTLM)\b")
    imap = flat.rlike(r"(?iU)\bLOGIN[ ]+\S+|\bAUTHENTICATE[ ]+(?:PLAIN|LOGIN)\b")
    pop3 = flat.rlike(r"(?iU)\b(?:USER|PASS)[ ]+\S+")
    return F.coalesce(
        F.when(protocol == "SMTP", smtp).when(protocol == "IMAP", imap).when(protocol == "POP3", pop3),
        F.lit(False),
    )


def starttls_command(text: Column) -> Column:
    return F.coalesce(flat_text(text).rlike(r"(?iU)(?:^|[^A-Za-z])(?:STARTTLS|STLS)\b"), F.lit(False))


def starttls_tag(text: Column) -> Column:
    tag = F.regexp_extract(flat_text(text), r"(?iU)^([A-Za-z0-9*+._-]{1,16})[ ]+(?:STARTTLS|STLS)\b", 1)
    return F.when(tag != "", tag)


def starttls_advertised(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?iU)\b(?:STARTTLS|STLS)\b"), F.lit(False))


# ------------------------------------------------------------------ vocabulary
def payload_text(payload_hex: Column) -> Column:
    return F.decode(F.unhex(F.replace(payload_hex, F.lit(":"), F.lit(""))), "ISO-8859-1")


def has_mail_words(text: Column) -> Column:
    return any_of(text.contains(token) for token in PAYLOAD_TOKENS)


def _count(text: Column, token: str) -> Column:
    removed = F.replace(text, F.lit(token), F.lit(""))
    return ((F.length(text) - F.length(removed)) / len(token)).cast("int")


def vocabulary_scores(text: Column) -> Column:
    """ARRAY<STRUCT<protocol, score>>: non-overlapping literal hits per protocol."""
    lowered = F.lower(text)
    scores = []
    for protocol, tokens in MAIL_VOCABULARY.items():
        total = F.lit(0)
        for token in tokens:
            total = total + _count(lowered, token)
        scores.append(F.struct(F.lit(protocol).alias("protocol"), total.alias("score")))
    return F.array(*scores)


def greeting_protocols(text: Column) -> Column:
    """Protocols whose server greeting opens the text."""
    opened = F.lower(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", ""))
    return F.array_compact(F.array(*[
        F.when(any_of(opened.startswith(word) for word in words), F.lit(protocol))
        for protocol, words in SERVER_GREETINGS.items()
    ]))
