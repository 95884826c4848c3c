import re

from helpers import ODD_TEXTS, empty_documents, odd_documents
from pyspark.sql import functions as F

from sealcheck.llm import pii

CASES = {
    "card 4111 1111 1111 1111 and 4111-1111-1111-1111": ["card", "card"], "bad card 4111111111111112": [],
    "+1 (499) 555-6503%%%": ["phone"], "+49 30 123 4567 or (555) 123-4567": ["phone", "phone"], "that.92@mail2.example.com### x": ["email"],
    "240.56.125.154 and 64.147.79.24. not 300.1.1.1": ["ip", "ip"], "2024-02-29 29.02.2024 not 2023-02-29": ["date", "date"],
    "DE89 3704 0044 0532 0130 00 not DE88370400440532013000": ["iban"], "123-45-6789 not 000-12-3456": ["ssn"],
    'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"': ["secret"], "9" * 500: [], "plain 12 words": []}


def masked(spark, texts, key="k"):
    return [(r["text"], r["found"]) for r in pii.with_pseudonyms(odd_documents(spark, texts), key).orderBy(F.col("row.doc_id").asc_nulls_last()).select("out.*").collect()]


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_kinds_and_formats(spark):
    for (text, kinds), (new, found) in zip(CASES.items(), masked(spark, list(CASES))):
        assert found == kinds, text
        if not kinds:
            assert new == text
        elif kinds[0] not in ("email", "ip"):
            assert len(new) == len(text) and re.sub("[0-9a-fA-F]", "", new) == re.sub("[0-9a-fA-F]", "", text) and new != text


def test_pseudonyms_stay_valid_linked_and_keyed(spark):
    card = "4111111111111111"
    (a, _), (b, _), (c, _), *_ = masked(spark, [card, f"x {card} y", "4111 1111 1111 1111"])
    assert luhn(a) and a != card and b == f"x {a} y" and c.replace(" ", "") == a
    assert masked(spark, [card], "other key")[0][0] != a
    again = [t for t, _ in masked(spark, [a, *[t for t, _ in masked(spark, list(CASES))]])]
    assert luhn(again[0])


BESIDE = {
    "+1 (826) 555-4081 190.137.223.204": ["phone", "ip"], "+44 20 7946 0958 190.137.223.204": ["phone", "ip"], "+49 30 1234567 2024-02-29": ["phone", "date"],
    "+49 30 1234567 4111 1111 1111 1111": ["phone", "card"], "+44 20 7946 0958 826 555-4081": ["phone", "phone"],
    "4111 1111 1111 1111 123": ["card"], "12 4111 1111 1111 1111": ["card"], "2024 4111 1111 1111 1111": ["card"], "4111 1111 1111 1111 378282246310005": ["card", "card"],
    "4111 1111 1111 1111 190.137.223.204": ["card", "ip"], "4111111111111111 2024-02-29 123-45-6789": ["card", "date", "ssn"],
    "4111 1111 1111 1111 826 555-4081": ["card", "phone"], "4111 1111 1111 1111 826.555.4081": ["card", "phone"], "4111 1111 1111 1111 29.02.2024": ["card", "date"],
    "DE89 3704 0044 0532 0130 00 AB1": ["iban"], "DE89 3704 0044 0532 0130 00 4111 1111 1111 1111": ["iban", "card"], "4111 1111 1111 1111 7.bob@example.com": ["card", "email"]}


def test_two_values_side_by_side(spark):
    for (text, kinds), (new, found) in zip(BESIDE.items(), masked(spark, list(BESIDE))):
        assert found == kinds, text
        assert "1111 1111" not in new and "4081" not in new and "223" not in new, new
    (one, _), (two, _), *_ = masked(spark, ["+1 (826) 555-4081", "+1 (826) 555-4081 190"])
    assert two == one + " 190"
    (card, _), (beside, _), *_ = masked(spark, ["4111 1111 1111 1111", "12 4111 1111 1111 1111 123"])
    assert beside == f"12 {card} 123"
    numbers = "4 12 " * 1000
    assert masked(spark, [numbers + "4111 1111 1111 1111"])[0][0] == numbers + card


def test_network_is_a_bijection(spark):
    pairs = spark.range(17 * 30).select((F.col("id") / 30).cast("long").alias("a"), (F.col("id") % 30).alias("b"))
    out = pairs.select(pii.feistel("k", "t", F.col("a"), F.col("b"), F.lit(17), F.lit(30)).alias("p")).select("p.*")
    assert out.distinct().count() == 17 * 30 and out.where("a < 0 OR a > 16 OR b < 0 OR b > 29").count() == 0
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert numbers.select(pii.permute_digits("k", "n", F.col("d")).alias("p")).where("length(p) = 3").distinct().count() == 1000


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = {r["doc_id"]: r["text"] for r in pii.with_pseudonyms(docs, "k").select("row.doc_id", "out.text").collect()}
    assert found[0] is None and all(found[i] == t for i, t in enumerate(ODD_TEXTS))
    assert pii.with_pseudonyms(empty_documents(spark), "k").count() == 0
