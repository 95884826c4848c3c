"""PII: format-preserving pseudonyms by a keyed Feistel network.

Numbers and dates are found by pattern, validated (card by its check digit, IBAN by modulo 97, address bytes below 256, area and group of
a social security number, a day that exists between 1900 and 2099), and permuted within their format by a keyed bijection, so equal
values have equal pseudonyms in every document and different values stay different. Separators, length, country code and check
digits' validity are kept. Numbers that do not validate stay as they are. A value ends at its own shape, so that the number beside it is
found too; only an international number without a fixed length may take a plain number behind it, up to 15 digits. Mail addresses and secrets are no numbers: their
local part or hex digits are replaced by keyed digests of the same length, which links equal values too.

Only DataFrame functions run. A null text stays null; an empty text has nothing to replace. Rows are treated one by one, so
repeated rows, null ids and extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.llm import common

#: Key of the registered query; a user passes their own.
DEMO_KEY = "demonstration key"
ROUNDS = 10

# Fixed patterns, in the order they are tried. The classes tell them apart again in `kind_of`.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])"
#: Length of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban_shape(size: int, countries: str) -> str:
    """Groups of four, the last one shorter."""
    groups, rest = divmod(size - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{groups}}}" + (f" ?[0-9A-Z]{{{rest}}}" if rest else "")


IBAN = r"(?<![0-9A-Za-z])(?:" + "|".join(_iban_shape(n, c) for n, c in IBAN_LENGTHS.items()) + r")(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: A card as it is printed: one group, fours, or 4-6-5, 4-6-4 and 4-3-3-3.
CARD_SHAPE = (r"(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}(?: [0-9]{1,3})?|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}(?:-[0-9]{1,3})?"
              r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}[ -][0-9]{3}[ -][0-9]{3}[ -][0-9]{3})(?![0-9])")
_NATIONAL = r"(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_DAY = r"(?:[0-9]{4}-[01][0-9]-[0-3][0-9]|[0-3][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2}|[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2})(?![0-9])"
# Where another value begins, an international number ends; a national number is one only after enough digits for a phone.
_OTHER = rf"(?:(?<![0-9.]){_BYTE}(?:\.{_BYTE}){{3}}(?![0-9]|\.[0-9])|{_DAY}|{SSN}|{CARD_SHAPE}|{SECRET}|{EMAIL})"
_ONE = r"[ .-]?\(?[0-9](?:\)(?=[ .-]?[0-9]))?"
#: Digits after the country code where all numbers of a country have the same length.
_PLANS = {8: "45|47|65|852", 9: "31|33|34|41|48|61|351|420|971", 10: "1|7|30|44|52|90|91"}
_FIXED = "|".join(rf"\+(?:{codes})(?:[ .-]?\(0\))?(?:(?![ .-]{_OTHER}){_ONE}){{{n}}}(?![0-9])" for n, codes in _PLANS.items())
_MORE = r"(?:(?:[ .-](?=\(|[0-9]{2}))?\(?[0-9](?:\)(?=[ .-]?[0-9]))?)"
_OPEN = rf"\+(?:(?![ .-]{_OTHER}){_MORE}){{7}}(?:(?![ .-](?:{_OTHER}|{_NATIONAL})){_MORE}){{0,8}}(?![0-9])"
# shapes of a known length first, then the open one, which ends at 15 digits
PHONE = rf"(?:(?<![0-9+])\+[0-9]{{1,3}}[ .-]?)?{_NATIONAL}|{_FIXED}|{_OPEN}"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
# Whether a card number validates no pattern can tell, so groups of digits are matched as a run as long as it is, except a last group
# that begins another value, and `_run_values` finds the values in it.
_TAIL = r"(?<=[ -][0-9]{1,40})"
RUN = (rf"(?<![0-9])[0-9](?=[0-9 -]{{12}})[0-9 -]*[0-9](?![0-9])(?!(?<=[ -][0-9]{{1,3}})(?:\.[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9]))"
       rf"(?!(?<=[ -][0-9]{{2}})(?:/[0-9]{{2}}/|\.[0-9]{{2}}\.)[0-9]{{4}}(?![0-9]))"
       rf"(?!(?<=[ -][0-9]{{3}})\.[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9]))(?!(?<=[ -][0-9]{{3}}[ -][0-9]{{3}})\.[0-9]{{4}}(?![0-9]))"
       rf"(?!{_TAIL}[A-Za-z._%+-][A-Za-z0-9._%+-]{{0,63}}@|{_TAIL}@)(?!{_TAIL}[a-fA-F][0-9a-fA-F]{{15,127}}(?![0-9A-Za-z]))")
PATTERN = "|".join([EMAIL, SECRET, IBAN, IPV4, DATE, SSN, PHONE, RUN])
KINDS = ["email", "secret", "iban", "ip", "date", "ssn", "phone", "card"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _prf(key: str, kind: Column | str, step: Column, value: Column) -> Column:
    """A keyed 60-bit number of (kind, step, value)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.concat_ws("|", F.lit(key), kind, step.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.sha2(text, 256)), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, high: Column, low: Column, high_size: Column, low_size: Column) -> Column:
    """A keyed bijection of the pairs (high below high_size, low below low_size), as a struct (a, b).

    Rounds add a keyed function of one half to the other in turn, which is undone by subtracting in reverse order.
    """
    scope = F.concat_ws("/", F.lit(kind), high_size.cast("string"), low_size.cast("string"))
    start = F.struct(high.cast("long").alias("a"), low.cast("long").alias("b"))

    def step(state: Column, i: Column) -> Column:
        a = F.when(i % 2 == 0, (state["a"] + _prf(key, scope, i, state["b"]) % high_size) % high_size).otherwise(state["a"])
        b = F.when(i % 2 == 1, (state["b"] + _prf(key, scope, i, state["a"]) % low_size) % low_size).otherwise(state["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """Another digit string of the same length, at most 36 digits, by the keyed bijection."""
    size = F.length(digits)
    cut = F.floor(size / 2).cast("int")
    rest = size - cut
    out = feistel(key, kind, F.substr(digits, F.lit(1), cut), F.substr(digits, cut + 1, rest), _power(cut), _power(rest))
    return F.transform(F.array(out), lambda s: F.concat(F.lpad(s["a"].cast("string"), cut, "0"), F.lpad(s["b"].cast("string"), rest, "0")))[0]


def _fill_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def put(state: Column, mark: Column) -> Column:
        digit = mark.rlike("^[0-9]$")
        return F.struct(F.concat(state["text"], F.when(digit, F.substr(digits, state["next"], F.lit(1))).otherwise(mark)).alias("text"),
                        F.when(digit, state["next"] + 1).otherwise(state["next"]).alias("next"))

    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["text"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right; those whose place modulo 2 is ``doubled`` count twice, less 9 when over 9."""
    def add(total: Column, pair: Column) -> Column:
        twice = pair["d"] * 2
        return total + F.when(pair["i"] % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(pair["d"])
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(F.filter(places, lambda p: p["d"].isNotNull()), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """Remainder of an account number's letters and digits, letters as 10 to 35."""
    def step(rest: Column, mark: Column) -> Column:
        digit = mark.rlike("^[0-9]$")
        return F.when(digit, (rest * 10 + mark.cast("long")) % 97).otherwise((rest * 100 + F.ascii(mark) - 55) % 97).cast("long")
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def _iban_bare(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def _iban_valid(m: Column) -> Column:
    bare = _iban_bare(m)
    return (F.length(bare).between(15, 34)) & (_mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1)


def _date_parts(m: Column) -> tuple[Column, Column, Column]:
    iso = m.rlike("^[0-9]{4}")
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4))
    month = F.when(iso, F.substring(m, 6, 2)).otherwise(F.substring(m, 4, 2))
    day = F.when(iso, F.substring(m, 9, 2)).otherwise(F.substring(m, 1, 2))
    return year, month, day


def _date_of(m: Column) -> Column:
    """The day, or null: ISO order, else day before month, else month before day where only that exists."""
    year, month, day = _date_parts(m)
    direct = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    swapped = F.when(m.contains("/"), F.try_to_date(F.concat_ws("-", year, day, month), "yyyy-MM-dd"))
    found = F.coalesce(direct, swapped)
    return F.when(F.year(found).between(1900, 2099), found)


#: Days of 1900 to 2099: 17 * 4297.
_DAY_HIGH, _DAY_LOW, _DAY_ONE = 17, 4297, "1900-01-01"


def _date_pseudonym(key: str, m: Column) -> Column:
    found = _date_of(m)
    index = F.datediff(found, F.lit(_DAY_ONE).cast("date"))
    out = feistel(key, "date", F.floor(index / _DAY_LOW), index % _DAY_LOW, F.lit(_DAY_HIGH), F.lit(_DAY_LOW))
    day = F.transform(F.array(out), lambda s: F.date_add(F.lit(_DAY_ONE).cast("date"), (s["a"] * _DAY_LOW + s["b"]).cast("int")))[0]
    year, month, dom = _date_parts(m)
    swapped = F.try_to_date(F.concat_ws("-", year, month, dom), "yyyy-MM-dd").isNull()
    return (F.when(m.rlike("^[0-9]{4}"), F.date_format(day, "yyyy-MM-dd"))
            .when(m.contains("."), F.date_format(day, "dd.MM.yyyy"))
            .when(swapped, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy")))


def _ip_bytes(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda b: b.cast("long"))


def _ip_pseudonym(key: str, m: Column) -> Column:
    b = _ip_bytes(m)
    out = feistel(key, "ip", b[0] * 256 + b[1], b[2] * 256 + b[3], F.lit(65536), F.lit(65536))
    return F.transform(F.array(out), lambda s: F.concat_ws(".", *[x.cast("string") for x in (
        F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))[0]


def _card_pseudonym(key: str, m: Column) -> Column:
    digits = _digits(m)
    body = permute_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
    return F.transform(F.array(body), lambda b: _fill_digits(m, F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string"))))[0]


def _iban_pseudonym(key: str, m: Column) -> Column:
    """Country and letters stay, the account's digits are permuted, the two check digits follow."""
    bare = _iban_bare(m)
    country, account = F.substring(bare, 1, 2), F.substr(bare, F.lit(5))
    body = F.transform(F.array(_fill_digits(account, permute_digits(key, "iban", F.rpad(_digits(account), F.greatest(F.length(_digits(account)), F.lit(2)), "0")))),
                       lambda a: F.concat(F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))[0]
    # digits go back into the spacing of the text; letters stay where they were
    return F.transform(F.array(body), lambda t: _fill_digits(m, _digits(t)))[0]


def _ssn_valid(m: Column) -> Column:
    area, group, serial = F.substring(m, 1, 3), F.substring(m, 5, 2), F.substring(m, 8, 4)
    return ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")


def _ssn_pseudonym(key: str, m: Column) -> Column:
    """A bijection of the valid numbers: 898 areas, 99 groups by 9999 serials."""
    area = F.substring(m, 1, 3).cast("long")
    high = F.when(area > 666, area - 2).otherwise(area - 1)
    low = (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1
    out = feistel(key, "ssn", high, low, F.lit(898), F.lit(99 * 9999))
    return F.transform(F.array(out), lambda s: F.concat_ws(
        "-", F.lpad(F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1).cast("string"), 3, "0"),
        F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")))[0]


def _phone_pseudonym(key: str, m: Column) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    local = F.substr(m, F.length(country) + 1)
    return F.concat(country, _fill_digits(local, permute_digits(key, "phone", _digits(local))))


def _email_pseudonym(key: str, m: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@"),
                    F.regexp_extract(m, "@(.*)$", 1))


def _secret_pseudonym(key: str, m: Column) -> Column:
    digest = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"secret{i}"), F.lower(m)), 256) for i in range(2)])
    same = F.substr(digest, F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(same)).otherwise(same)


def kind_of(m: Column) -> Column:
    """The kind of a match whose value validates, else null."""
    whole = {kind: f"^(?:{pattern})$" for kind, pattern in zip(KINDS, [EMAIL, SECRET, IBAN, IPV4, DATE, SSN, PHONE, CARD])}
    bytes_ok = F.forall(_ip_bytes(m), lambda b: b < 256)
    return (F.when(m.rlike(whole["email"]), "email")
            .when(m.rlike(whole["date"]), F.when(_date_of(m).isNotNull(), "date"))
            .when(m.rlike(whole["ip"]), F.when(bytes_ok, "ip"))
            .when(m.rlike(whole["ssn"]), F.when(_ssn_valid(m), "ssn"))
            .when(m.rlike(whole["phone"]), F.when(F.length(_digits(m)).between(7, 15), "phone"))
            .when(m.rlike(whole["card"]), F.when(luhn_sum(_digits(m), 1) % 10 == 0, "card"))
            .when(m.rlike(whole["secret"]), "secret")
            .when(m.rlike(whole["iban"]), F.when(_iban_valid(m), "iban")))


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    return (F.when(kind == "email", _email_pseudonym(key, m)).when(kind == "date", _date_pseudonym(key, m))
            .when(kind == "ip", _ip_pseudonym(key, m)).when(kind == "ssn", _ssn_pseudonym(key, m))
            .when(kind == "phone", _phone_pseudonym(key, m)).when(kind == "card", _card_pseudonym(key, m))
            .when(kind == "secret", _secret_pseudonym(key, m)).when(kind == "iban", _iban_pseudonym(key, m)).otherwise(m))


def _run_values(m: Column) -> Column:
    """The values of a run of digit groups and the text between them, in order, as structs (m, kind).

    From each group the shapes of four, three, one and five groups are tried, the first that validates is a value. Where a value may
    be grouped in any way, at the start of the run and behind a value, the longest card number is tried after these.
    """
    ends = r"[ -]+$"
    shape = f"^(?:{DATE}|{SSN}|{_NATIONAL}|{SECRET}|{CARD_SHAPE})$"

    def with_groups(groups: Column) -> Column:
        def joined(first: Column, n: Column | int) -> Column:
            return F.array_join(F.slice(groups, first + 1, n), "")

        def shaped(i: Column) -> Column:
            tries = F.transform(F.array(*[F.lit(n) for n in (4, 3, 1, 5)]), lambda n: F.struct(n.alias("n"), F.regexp_replace(joined(i, n), ends, "").alias("m")))
            tries = F.filter(tries, lambda t: (i + t["n"] <= F.size(groups)) & t["m"].rlike(shape))
            kinds = F.transform(tries, lambda t: F.struct(t["n"].alias("n"), kind_of(t["m"]).alias("kind")))
            return F.get(F.filter(kinds, lambda t: t["kind"].isNotNull()), F.lit(0))

        def longest(i: Column) -> Column:
            card = F.regexp_extract(joined(i, 19), "^" + CARD, 0)
            valid = (card != "") & (luhn_sum(_digits(card), 1) % 10 == 0)
            return F.when(valid, F.struct(F.size(F.split(card, "[ -]")).alias("n"), F.lit("card").alias("kind")))

        def step(state: Column, i: Column) -> Column:
            hit = F.when(i >= state["next"], F.coalesce(shaped(i), F.when(i == state["next"], longest(i))))
            return F.transform(F.array(hit), lambda h: F.when(h.isNull(), state).otherwise(F.struct(
                (i + h["n"]).alias("next"), F.concat(state["hits"], F.array(F.struct(i.alias("i"), h["n"].alias("n"), h["kind"].alias("kind")))).alias("hits"))))[0]

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,n:int,kind:string>>").alias("hits"))
        hits = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda s: F.concat(
            s["hits"], F.array(F.struct(F.size(groups).alias("i"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("kind")))))

        def pieces(hits: Column) -> Column:
            def piece(h: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(hits, k - 1)["i"] + F.get(hits, k - 1)["n"]).otherwise(0)
                text = joined(h["i"], h["n"])
                none = F.lit(None).cast("string")
                return F.array(F.struct(joined(before, h["i"] - before).alias("m"), none.alias("kind")),
                               F.struct(F.regexp_replace(text, ends, "").alias("m"), h["kind"].alias("kind")),
                               F.struct(F.regexp_extract(text, ends, 0).alias("m"), none.alias("kind")))
            return F.flatten(F.transform(hits, piece))

        return F.transform(F.array(hits), pieces)[0]

    return F.transform(F.array(F.regexp_extract_all(m, F.lit("[0-9]+[ -]*"), F.lit(0))), with_groups)[0]


def values_of(m: Column) -> Column:
    """A match as structs (m, kind): itself, or the values of a run of digit groups."""
    whole = F.transform(F.array(kind_of(m)), lambda kind: F.when(
        m.rlike("^[0-9][0-9 -]*[0-9]$") & (kind.isNull() | (kind == "card")), _run_values(m)).otherwise(F.array(F.struct(m.alias("m"), kind.alias("kind")))))
    return whole[0]


def with_pseudonyms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Columns ``row`` (struct of all columns of ``docs``) and ``out`` (text with pseudonyms, found: kinds in order)."""
    pattern = F.lit(PATTERN)
    # every pattern needs three digits in a row, a digit group with a separator, an @, or hex digits: a cheap first look
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("_text"))
    rows = rows.select("row", "_text", F.when(F.col("_text").rlike("[0-9@]"), F.regexp_extract_all("_text", pattern, F.lit(0))).alias("_found"))
    rows = rows.select("row", "_text", F.transform("_found", values_of).alias("_found"))
    rows = rows.select("row", "_text", "_found", F.transform("_found", lambda v: F.array_join(F.transform(v, lambda x: pseudonym(key, x["kind"], x["m"])), "")).alias("_new"),
                       F.when(F.size("_found") > 0, F.split("_text", PATTERN, -1)).alias("_parts"))
    joined = F.array_join(F.transform(F.arrays_zip("_parts", "_new"), lambda p: F.concat(F.coalesce(p["_parts"], F.lit("")), F.coalesce(p["_new"], F.lit("")))), "")
    found = F.filter(F.transform(F.flatten(F.coalesce(F.col("_found"), F.array().cast("array<array<struct<m:string,kind:string>>>"))), lambda x: x["kind"]), lambda k: k.isNotNull())
    return rows.select("row", F.struct(F.when(F.col("_parts").isNull(), F.col("_text")).otherwise(joined).alias("text"), found.alias("found")).alias("out"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = [(F.size("out.found") - F.size(F.array_remove("out.found", kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return with_pseudonyms(docs, DEMO_KEY).select("row.doc_id", F.col("out.text").alias("text"), *counts)
