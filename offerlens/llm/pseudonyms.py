"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by pattern and validated (check digits, ranges, calendar). A valid value becomes a whole number in a domain of
exactly A x B values and is permuted by a keyed Feistel network on A x B, so the result is again a valid value of the same
format: a card keeps its length and gets a matching check digit, a date stays a date, separators stay in place. The same value
under the same key gets the same pseudonym in every document, and different values stay different.

Kinds: payment cards (check digit), social security numbers, IPv4 addresses, telephone numbers (national 3-3-4 numbers with or without
country code 1, and international ones after +, together or in groups), dates from 1800 to 2199, IBANs (check digits; country and letters stay;
together or in groups), and the local part of e-mail addresses (letters and digits, case folded; the domain stays).

National numbers whose area code and exchange are 200 or more are permuted among themselves. All others are permuted among themselves too where
country code or brackets show that a telephone number is meant; without either they stay.

Only DataFrame operations. Text is cut at the matches and joined again, once, whatever the number of matches.

Defined results. A null text stays null with 0 found. What looks like a value but is not valid stays as it is. Texts of any length are handled whole, row by
row: no shuffle, repeated rows and empty tables need no special case. Input columns named like an output column are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.names import free_name

ROUNDS = 8
# Characters of an IBAN by country.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED_IBAN = "|".join(rf"(?:{names.replace(' ', '|')})\d{{2}}(?:[ -]?[A-Z0-9]){{{size - 4}}}" for size, names in IBAN_SIZES.items())
# Groups of a number have one separator where that gives a whole number, so that what follows is not read as a further group.
_GROUPS = "|".join(rf"\d(?:{mark}?\d){{5,11}}(?!\d)(?![./-]\d)" for mark in (" ", "-", r"\.", "[ .-]"))
# The forms in which values are written.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|{_GROUPED_IBAN})(?![A-Za-z0-9])",
    "date": r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    "phone": r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "world_phone": rf"\+(?:\d{{8,15}}(?!\d)|(?=(?:[ .()-]{{0,2}}\d){{8}})\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?(?:{_GROUPS}))",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}



def _permuted(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """struct(l, r): the pair (left, right) of a x b values under the keyed permutation; even rounds move l, odd ones r."""

    def noise(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_l = F.when(even, F.pmod(s["l"] + F.pmod(noise(i, s["r"]), a), a)).otherwise(s["l"])
        moved_r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(noise(i, s["l"]), b), b))
        return F.struct(moved_l.alias("l"), moved_r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sub(text: Column, first: int | Column, n: int | Column) -> Column:
    return F.substring(text, first, n)


def _string(text: Column, base: int, key: str, tweak: str) -> Column:
    """A string of digits of the base under a permutation of all strings of its length, in chunks of at most 16."""

    def chunk(c: Column) -> Column:
        n = F.length(c)
        a = F.floor(n / 2).cast("int")
        value = lambda x: F.when(F.length(x) > 0, F.conv(x, base, 10).cast("long")).otherwise(F.lit(0).cast("long"))
        size = lambda k: F.pow(F.lit(float(base)), k).cast("long")
        pair = _permuted(value(_sub(c, F.lit(1), a)), value(_sub(c, a + 1, n - a)), size(a), size(n - a), key, F.concat_ws("|", F.lit(tweak), n.cast("string")))
        back = lambda x, k: F.when(k > 0, F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), k, F.lit("0"))).otherwise("")
        return _let(pair, lambda p: F.concat(back(p["l"], a), back(p["r"], n - a)))

    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 16).cast("int"))
    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(starts, lambda k: chunk(_sub(text, k * 16 + 1, F.lit(16)))), ""))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _laid_out(layout: Column, values: Column, slots: str) -> Column:
    """The layout with its characters of the class `slots` replaced one after the other by those of `values`."""
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"))

    def put(s: Column, c: Column) -> Column:
        slot = c.rlike(slots)
        return F.struct((s["next"] + slot.cast("int")).alias("next"), F.concat(s["out"], F.when(slot, F.substring(values, s["next"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(_characters(layout), start, put, lambda s: s["out"])


def _check_digit(payload: Column) -> Column:
    """The digit that completes a payload of digits to a card number."""
    doubled = F.transform(_characters(F.reverse(payload)), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, d: s + d), F.lit(10)).cast("string")


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        payload, last = F.substring(d, F.lit(1), F.length(d) - 1), F.substring(d, F.length(d), F.lit(1))
        return F.when(_check_digit(payload) == last, _let(_string(payload, 10, key, "card"), lambda p: _laid_out(m, F.concat(p, _check_digit(p)), r"\d")))

    return _let(_digits(m), made)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    pair = _permuted(area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    two = lambda x, n: F.lpad(x.cast("string"), n, "0")
    shown = _let(pair, lambda p: F.concat_ws("-", two(p["l"] + 1 + (p["l"] >= 665).cast("long"), 3), two(F.floor(p["r"] / 9999) + 1, 2), two(p["r"] % 9999 + 1, 4)))
    return F.when(valid, shown)


def _ipv4(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    pair = lambda o: _permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ipv4"))
    shown = lambda p: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256)])
    return _let(parts, lambda o: F.when(F.forall(o, lambda x: x < 256), _let(pair(o), shown)))


def _phone(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        national = F.substring(d, F.length(d) - 9, F.lit(10))
        area, exchange, line = (F.substring(national, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
        value = ((area - 200) * 800 + (exchange - 200)) * 10000 + line
        pair = _permuted(F.floor(value / 80000), value % 80000, F.lit(80000), F.lit(80000), key, F.lit("phone"))
        # The 3.6 * 10^9 others: 200,000 heads with an area code below 200, then 160,000 with an exchange below 200.
        other = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange) * 10000 + line
        other_pair = _permuted(F.floor(other / 60000), other % 60000, F.lit(60000), F.lit(60000), key, F.lit("other phone"))
        three = lambda x: F.lpad(x.cast("string"), 3, "0")

        def laid(a: Column, e: Column, v: Column) -> Column:
            number = F.concat(three(a), three(e), F.lpad((v % 10000).cast("string"), 4, "0"))
            return _laid_out(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), number), r"\d")

        def shown(p: Column) -> Column:
            v = p["l"] * 80000 + p["r"]
            head = F.floor(v / 10000)
            return laid(F.floor(head / 800) + 200, head % 800 + 200, v)

        def other_shown(p: Column) -> Column:
            v = p["l"] * 60000 + p["r"]
            head = F.floor(v / 10000)
            low, rest = head < 200_000, head - 200_000
            return laid(F.when(low, F.floor(head / 1000)).otherwise(F.floor(rest / 200) + 200), F.when(low, head % 1000).otherwise(rest % 200), v)

        meant = (F.length(d) > 10) | F.contains(m, F.lit("("))
        return F.when((area >= 200) & (exchange >= 200), _let(pair, shown)).when(meant, _let(other_pair, other_shown))

    return _let(_digits(m), made)


def _world_phone(m: Column, key: str) -> Column:
    """Two digits after + stay. Eleven digits after +1 are a national number."""
    made = lambda d: _laid_out(m, F.concat(F.substring(d, 1, 2), _string(F.substring(d, F.lit(3), F.length(d)), 10, key, "world_phone")), r"\d")
    return _let(_digits(m), lambda d: F.when(d.rlike(r"^1\d{10}$"), _phone(m, key)).otherwise(made(d)))


def _date(m: Column, key: str) -> Column:
    """All formats share one permutation of the 146,097 = 189 x 773 days of 1800 to 2199."""
    part = lambda k: F.regexp_extract(m, r"^(\d+)\D(\d+)\D(\d+)$", k)
    iso = F.length(part(1)) == 4
    american = F.contains(m, F.lit("/")) & (part(1).cast("int") <= 12)
    year = F.when(iso, part(1)).otherwise(part(3))
    month = F.when(iso | ~american, part(2)).otherwise(part(1))
    day = F.when(iso, part(3)).when(american, part(2)).otherwise(part(1))
    first = F.lit("1800-01-01").cast("date")
    found = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
    number = lambda d: F.datediff(d, first).cast("long")
    pair = lambda d: _permuted(F.floor(number(d) / 773), number(d) % 773, F.lit(189), F.lit(773), key, F.lit("date"))

    def shown(p: Column) -> Column:
        d = F.date_add(first, (p["l"] * 773 + p["r"]).cast("int"))
        wide = lambda x, k: F.lpad(x.cast("string"), F.greatest(F.length(part(k)), F.length(x.cast("string"))), F.lit("0"))
        mark = F.regexp_extract(m, r"\D", 0)
        a, b = F.when(american, F.month(d)).otherwise(F.day(d)), F.when(american, F.day(d)).otherwise(F.month(d))
        return F.when(iso, d.cast("string")).otherwise(F.concat(wide(a, 1), mark, wide(b, 2), mark, F.year(d).cast("string")))

    return _let(found, lambda d: F.when(d.isNotNull() & F.year(d).between(1800, 2199), _let(pair(d), shown)))


def _remainder(text: Column) -> Column:
    """Remainder modulo 97 of digits and capitals, A counting as 10."""
    def add(s: Column, c: Column) -> Column:
        return F.when(c.rlike(r"\d"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_characters(text), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    def made(c: Column) -> Column:
        country, account = F.substring(c, 1, 2), F.substring(c, F.lit(5), F.length(c))
        valid = _remainder(F.concat(account, F.substring(c, 1, 4))) == 1
        check = lambda a: F.lpad((98 - _remainder(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
        new = _let(_laid_out(account, _string(_digits(account), 10, key, "iban"), r"\d"), lambda a: F.concat(country, check(a), a))
        return F.when(valid, _laid_out(m, new, "[A-Z0-9]"))

    return _let(F.regexp_replace(m, "[ -]", ""), made)


def _email(m: Column, key: str) -> Column:
    local, rest = F.lower(F.regexp_extract(m, "^([^@]*)@", 1)), F.regexp_extract(m, "@.*$", 0)
    plain = F.regexp_replace(local, "[^a-z0-9]", "")
    return F.concat(_laid_out(local, _string(plain, 36, key, "email"), "[a-z0-9]"), rest)


MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "phone": _phone, "world_phone": _world_phone, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """Pseudonym of one written value, null if it is of no kind or not valid."""
    out = F.lit(None).cast("string")
    for kind in reversed(FORMS):
        out = F.when(value.rlike(f"^(?:{FORMS[kind]})$"), MAKERS[kind](value, key)).otherwise(out)
    return out


def pseudonymise(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with pseudonyms in `text`, and `n_found` (int), the number of valid values that were replaced."""
    form = "|".join(FORMS.values())
    t = F.col(text)
    some = t.rlike("[0-9@]") & t.rlike(form)
    values = F.transform(F.regexp_extract_all(t, F.lit(form), 0), lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    old, gaps = free_name(documents, "__values"), free_name(documents, "__gaps")
    found = documents.withColumn(old, F.when(some, values)).withColumn(gaps, F.when(F.col(old).isNotNull(), F.split(t, form)))
    joined = F.concat(
        F.element_at(gaps, 1),
        F.array_join(F.zip_with(old, F.slice(gaps, F.lit(2), F.size(old)), lambda v, gap: F.concat(F.coalesce(v["new"], v["old"]), gap)), ""),
    )
    n = F.when(F.col(old).isNull(), 0).otherwise(F.size(F.filter(old, lambda v: v["new"].isNotNull())))
    return found.withColumn("n_found", n).withColumn(text, F.when(F.col(old).isNotNull(), joined).otherwise(t)).drop(old, gaps)
