"""Personal data replaced by format-preserving pseudonyms.

Values are found by one pattern, validated (IBAN check digits, calendar, octets, number of
digits), and replaced by a keyed permutation of all values of their
format, so equal values have equal pseudonyms in all documents, different ones different
pseudonyms, and who has the key can go back.

The permutation is a Feistel network over two lists of numbers, each with its own radix:
in every round one list is shifted, place by place, by a hash of the key, the round, the
kind and the other list. Characters that belong to the format have radix 1.

| kind | what is permuted | what stays |
|---|---|---|
| email | letters and digits before the @, case by case | separators, domain |
| iban | characters after the check digits | country; check digits are made valid again; separators |
| ip | the four octets | |
| phone | digits after the country code | country code, separators |
| ssn | group and serial, never zero | area |
| date | the day, from 1900-01-01 to 2099-12-31 | year, day or month first; separators |
| card | all digits but the last | the Luhn remainder, so a valid number stays valid; separators |

The key is an argument or the session's `KEY_SETTING`; nothing is changed without one.

An IBAN, a phone number and a card are permuted without their separators, which go back to
their places, so one number has one pseudonym however it is printed. IBANs in groups of
four have the length of their country; cards are grouped 4-4-4-n, 4-6-4 or 4-6-5.

A date that is valid day first is read so. One that is valid month first only has a day
after the 12th, and so has its pseudonym, which therefore is read the same way.

Runs of digits in the form of a card are replaced whether or not their Luhn sum is right, as
mistyped cards are personal as well. Those with a wrong sum (ISBNs, time stamps and order
numbers may be among them) are of a kind of their own: `n_card` counts all that is replaced in this form,
`n_card_unchecked` those with a wrong sum. So are numbers with the country and length of an
IBAN and wrong check digits (`n_iban`, `n_iban_unchecked`); their check digits are permuted
with the rest, and stay wrong.

Everything is DataFrame functions. Defined results: a null text stays null and has no
values; rows that repeat are changed alike; an empty table gives an empty result; other
columns are left alone, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The setting of the session that the key is read from if none is given.
KEY_SETTING = "spark.tunetally.pii.key"
ROUNDS = 8
FIRST_DAY = "1900-01-01"
#: Days from FIRST_DAY to 2099-12-31, and those of them after the 12th of a month; radices
#: whose product is the next to each from above.
DAYS, DAY_RADICES = 73_049, (229, 319)
LATE_DAYS, LATE_RADICES = 44_249, (150, 295)
KINDS = ("email", "iban", "ip", "phone", "ssn", "date", "card")
#: The kinds of numbers in the form of a card or an IBAN that don't pass its check.
UNCHECKED = {"iban": "iban_unchecked", "card": "card_unchecked"}
#: Turns after which the permutation of an unchecked IBAN has left the valid ones, of which
#: there is one in 97.
IBAN_TURNS = 40

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Countries by the length of their IBANs.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _in_groups(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    last = f"[ -][A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[ -][A-Z0-9]{{4}}){{{fours}}}{last}"


_OF_COUNTRY = r"\A(?:" + "|".join(
    rf"(?:{c.replace(' ', '|')})[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, c in _IBAN_LENGTHS.items()
) + r")\z"
_GROUPED_IBAN = "|".join(_in_groups(n, c) for n, c in _IBAN_LENGTHS.items())
# Codes of countries, none of which starts another.
_COUNTRY_CODE = r"\A\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# One alternative per kind; where several fit at a place, the first one is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:[A-Z0-9]{{15,34}}|{_GROUPED_IBAN})(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z/.-])(?:(?:19|20)[0-9]{2}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2(?:19|20)[0-9]{2})(?![0-9A-Za-z]|[/.-][0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:([ -])(?:[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{6}\3[0-9]{4,5})|[0-9]{9,15})(?![0-9A-Za-z])",
}
# The groups of a later alternative are counted from the start of the whole pattern.
PATTERN = "|".join(PATTERNS[k] for k in KINDS)


def _own(kind: str) -> str:
    """The pattern of one kind, its groups counted from 1."""
    return rf"\A(?:{PATTERNS[kind].replace(chr(92) + '3', chr(92) + '1')})\z"


def _number(x: Column) -> Column:
    return x.cast("int")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value as the variable of a function: computed once, wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shifts(key: str, kind: str, step: Column, other: Column) -> Column:
    """A hash as hex text; four characters of it make the shift of one place."""
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), step.cast("string"), F.array_join(other, ",")), 512)


def feistel(left: Column, right: Column, left_radix: Column, right_radix: Column, key: str, kind: str, back: bool = False) -> Column:
    """Two lists of numbers permuted within their radices, as one list; at most 32 places
    in each."""

    def moved(values: Column, radices: Column, step: Column, other: Column) -> Column:
        def by(drawn: Column) -> Column:
            def one(value: Column, place: Column) -> Column:
                shift = F.conv(F.substring(drawn, place * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.pmod(value - shift if back else value + shift, F.get(radices, place))

            return F.transform(values, one)

        return _bound(_shifts(key, kind, step, other), by)

    def walk(radices: Column) -> Column:
        def turn(state: Column, step: Column) -> Column:
            even = step % 2 == 0
            new_left = moved(state["l"], radices["l"], step, state["r"])
            new_right = moved(state["r"], radices["r"], step, state["l"])
            return F.struct(
                F.when(even, new_left).otherwise(state["l"]).alias("l"),
                F.when(even, state["r"]).otherwise(new_right).alias("r"),
            )

        start = F.struct(left.alias("l"), right.alias("r"))
        return F.aggregate(order, start, turn, lambda s: F.concat(s["l"], s["r"]))

    steps = range(ROUNDS)
    order = F.array(*(F.lit(k) for k in (reversed(steps) if back else steps)))
    return _bound(F.struct(left_radix.alias("l"), right_radix.alias("r")), walk)


def _characters(value: Column, fixed: Column, key: str, kind: str, back: bool) -> Column:
    """`value` with its letters and digits permuted, each within its kind of character;
    the first `fixed` characters stay."""

    def parts(code: Column, free: Column) -> Column:
        base = F.when(free & code.between(48, 57), 48).when(free & code.between(65, 90), 65)
        base = base.when(free & code.between(97, 122), 97).otherwise(code)
        radix = F.when(free & (base == 48), 10).when(free & base.isin(65, 97), 26).otherwise(1)
        return F.struct(base.alias("base"), radix.alias("radix"), (code - base).alias("value"))

    def of_places(start: Column) -> Column:
        codes = F.transform(F.split(value, ""), F.ascii)
        return F.transform(codes, lambda code, place: parts(code, place >= start))

    def changed(places: Column) -> Column:
        half = F.floor(F.size(places) / 2).cast("int")
        left, right = F.slice(places, F.lit(1), half), F.slice(places, half + 1, F.size(places) - half)
        new = feistel(left["value"], right["value"], left["radix"], right["radix"], key, kind, back)
        return F.array_join(F.zip_with(new, places["base"], lambda x, b: F.char(x + b)), "")

    return _bound(_bound(fixed, of_places), changed)


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, "[ .()-]", "")


def _dressed(bare: Column, value: Column) -> Column:
    """The characters of `bare` with the separators of `value` at their places."""

    def put(state: Column, own: Column) -> Column:
        mark = own.isin(" ", ".", "(", ")", "-")
        out = F.concat(state["out"], F.when(mark, own).otherwise(F.substring(state["bare"], state["at"], F.lit(1))))
        return F.struct(out.alias("out"), (state["at"] + F.when(mark, 0).otherwise(1)).alias("at"), state["bare"].alias("bare"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), bare.alias("bare"))
    return F.aggregate(F.split(value, ""), start, put, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a text of digits, modulo 10."""
    turned = F.split(F.reverse(digits), "")

    def worth(d: Column, place: Column) -> Column:
        twice = _number(d) * 2
        return F.when(place % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(_number(d))

    return F.aggregate(F.transform(turned, worth), F.lit(0), lambda s, x: s + x) % 10


def _card(value: Column, key: str, back: bool) -> Column:
    def changed(bare: Column) -> Column:
        body = _characters(F.substring(bare, F.lit(1), F.char_length(bare) - 1), F.lit(0), key, "card", back)
        wanted = _luhn(bare)
        return _bound(body, lambda x: F.concat(x, F.pmod(wanted - _luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    return _dressed(_bound(_bare(value), changed), value)


def _mod97(value: Column) -> Column:
    """What an IBAN, its first four characters moved to the end, leaves modulo 97."""
    turned = F.concat(F.substring(value, F.lit(5), F.char_length(value)), F.substring(value, 1, 4))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(codes, F.lit(0), lambda s, x: F.when(x > 9, s * 100 + x).otherwise(s * 10 + x) % 97)


def _iban(value: Column, key: str, back: bool) -> Column:
    def changed(bare: Column) -> Column:
        body = F.substring(_characters(bare, F.lit(4), key, "iban", back), F.lit(5), F.char_length(bare))
        country = F.substring(bare, 1, 2)
        check = lambda x: F.lpad((98 - _mod97(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0")
        return _bound(body, lambda x: F.concat(country, check(x), x))

    return _dressed(_bound(_bare(value), changed), value)


def _iban_unchecked(value: Column, key: str, back: bool) -> Column:
    """All characters after the country permuted, again as long as the result is valid."""

    def once(bare: Column) -> Column:
        return _characters(bare, F.lit(2), key, "iban_unchecked", back)

    def changed(bare: Column) -> Column:
        turns = F.sequence(F.lit(0), F.lit(IBAN_TURNS))
        return F.aggregate(turns, bare, lambda x, k: F.when((k == 0) | (_mod97(x) == 1), once(x)).otherwise(x))

    return _dressed(_bound(_bare(value), changed), value)


def _ip(value: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), _number)
    radices = F.array(F.lit(256), F.lit(256))
    return F.array_join(feistel(F.slice(octets, 1, 2), F.slice(octets, 3, 2), radices, radices, key, "ip", back), ".")


def _phone(value: Column, key: str, back: bool) -> Column:
    def changed(bare: Column) -> Column:
        country = F.char_length(F.regexp_extract(bare, _COUNTRY_CODE, 0))
        return _characters(bare, country, key, "phone", back)

    return _dressed(_bound(_bare(value), changed), value)


def _ssn(value: Column, key: str, back: bool) -> Column:
    parts = F.split(value, "-")
    one = lambda k, n: (F.array(_number(F.get(parts, F.lit(k))) - 1), F.array(F.lit(n)))
    (group, groups), (serial, serials) = one(1, 99), one(2, 9999)
    new = feistel(group, serial, groups, serials, key, "ssn", back)
    text = lambda k, n: F.lpad((F.get(new, F.lit(k)) + 1).cast("string"), n, "0")
    return F.concat_ws("-", F.get(parts, F.lit(0)), text(0, 2), text(1, 4))


def _days(value: Column) -> tuple[Column, Column]:
    """The day that a date means year first or day first, and else month first; null if
    there is none."""
    plain = F.regexp_replace(value, "[/.]", "-")
    year_first, day_first, month_first = (F.try_to_timestamp(plain, F.lit(x)).cast("date") for x in ("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy"))
    is_year_first = value.rlike(r"\A[0-9]{4}")
    usual = F.when(is_year_first, year_first).otherwise(day_first)
    return usual, F.when(~is_year_first & usual.isNull(), month_first)


def _walked(number: Column, size: int, radices: tuple[int, int], key: str, kind: str, back: bool) -> Column:
    """A number below `size` permuted among these. The permutation of all numbers below the
    product of the radices is repeated while it leads beyond `size`, at most as often as
    there are numbers beyond it."""
    a, b = radices

    def once(x: Column) -> Column:
        new = feistel(F.array(F.floor(x / b).cast("int")), F.array(x % b), F.array(F.lit(a)), F.array(F.lit(b)), key, kind, back)
        return _bound(new, lambda n: F.get(n, F.lit(0)) * b + F.get(n, F.lit(1)))

    turns = F.sequence(F.lit(0), F.lit(a * b - size))
    return F.aggregate(turns, number, lambda x, k: F.when((k == 0) | (x >= size), once(x)).otherwise(x))


def _late_day(rank: Column) -> Column:
    """The day with this rank among the days after the 12th of a month."""
    first = F.lit(FIRST_DAY).cast("date")
    month = lambda m: F.add_months(first, m)
    starts = lambda m: F.date_diff(month(m), first) - m * 12
    # A month has 18.437 such days on average, and never strays two months from that.
    about = F.floor(rank * 2400 / LATE_DAYS).cast("int")
    months = F.transform(F.array(*(F.lit(k) for k in range(-3, 4))), lambda k: about + k)
    fitting = F.array_max(F.filter(months, lambda m: starts(m) <= rank))
    return _bound(fitting, lambda m: F.date_add(month(m), (rank - starts(m) + 12).cast("int")))


def _date(value: Column, key: str, back: bool) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    usual, late = _days(value)
    mark = F.regexp_extract(value, "[-/.]", 0)

    def by_day(day: Column) -> Column:
        new = _walked(F.date_diff(day, first), DAYS, DAY_RADICES, key, "date", back)
        new = F.date_add(first, new)
        return F.when(value.rlike(r"\A[0-9]{4}"), F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "dd-MM-yyyy"))

    def by_late_day(day: Column) -> Column:
        months = (F.year(day) - 1900) * 12 + F.month(day)
        new = _walked(F.date_diff(day, first) - months * 12, LATE_DAYS, LATE_RADICES, key, "date-month-first", back)
        return F.date_format(_bound(new, _late_day), "MM-dd-yyyy")

    order = F.when(usual.isNotNull(), _bound(usual, by_day)).otherwise(_bound(late, by_late_day))
    return F.regexp_replace(order, "-", mark)


_CHANGES = {"email": None, "iban": _iban, "iban_unchecked": _iban_unchecked, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}


def kind_of(value: Column) -> Column:
    """The kind of a match, null where it doesn't pass the check of its kind."""
    digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    passes = {
        "phone": digits.between(7, 15),
        "date": F.coalesce(*_days(value)).isNotNull(),
    }
    out = F.when(F.contains(value, F.lit("@")), "email")
    for kind in KINDS[1:]:
        found = F.when(passes.get(kind, F.lit(True)), kind)
        if kind == "card":
            found = F.when(_luhn(_bare(value)) == 0, kind).otherwise(UNCHECKED[kind])
        if kind == "iban":
            found = F.when(_mod97(_bare(value)) == 1, kind).when(_bare(value).rlike(_OF_COUNTRY), UNCHECKED[kind])
        out = out.when(value.rlike(_own(kind)), found)
    return out


def _email(value: Column, key: str, back: bool) -> Column:
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(_characters(name, F.lit(0), key, "email", back), F.lit("@"), domain)


_CHANGES["email"] = _email


def pseudonym(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a validated value; with `back`, the value of a pseudonym."""
    out = F.when(F.lit(False), value)
    for name, change in _CHANGES.items():
        out = out.when(kind.isin(name, UNCHECKED["card"]) if name == "card" else kind == name, change(value, key, back))
    return out.otherwise(value)


def _key(docs: DataFrame, key: str | None) -> str:
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: give one or set {KEY_SETTING}")
    return key


def _changed(docs: DataFrame, key: str, back: bool) -> tuple[DataFrame, str]:
    """`docs` with columns c0, c1, ... and `found`, the kinds of the values; and the name
    of the text's column, in which the values are replaced."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    text = f"c{names.index('text')}"
    matches = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    rows = plain.withColumn("matches", matches)
    typed = F.transform("matches", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    rows = rows.withColumn("typed", F.when(F.size("matches") > 0, typed))
    named = F.transform("typed", lambda t: pseudonym(t["m"], t["kind"], key, back))
    gaps = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, named, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return rows.select(
        *(F.when(F.size("matches") > 0, joined).otherwise(F.col(c)).alias(c) if c == text else c for c in plain.columns),
        F.coalesce(F.transform("typed", lambda t: t["kind"]), F.array().cast("array<string>")).alias("found"),
    ), text


def pseudonymised(docs: DataFrame, key: str | None = None, back: bool = False) -> DataFrame:
    """The rows of `docs` with all values in `text` replaced; with `back`, restored."""
    rows, _ = _changed(docs, _key(docs, key), back)
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the text with pseudonyms, the number of values of each kind, and how many of
    the IBANs and cards don't pass their check."""
    rows, text = _changed(docs.select("doc_id", "text"), _key(docs, key), False)

    def count(name: str, *kinds: str) -> Column:
        return F.size(F.filter("found", lambda k: k.isin(*kinds))).cast("long").alias(f"n_{name}")

    counts = [count(k, k, UNCHECKED.get(k, k)) for k in KINDS]
    wrong = [count(k, k) for k in UNCHECKED.values()]
    return rows.select(F.col("c0").alias("doc_id"), F.col(text).alias("text"), *counts, *wrong)
