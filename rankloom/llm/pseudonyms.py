"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

A value that passes the checks of its kind is replaced by another valid value of the same
format. The replacement is a keyed permutation (a Feistel network over the value's positions,
each with its own radix), so equal values get equal pseudonyms in every document, different
values get different ones, and who holds the key can invert it. Nothing is looked up or
shuffled: every row is rewritten where it lies.

============ ================================================== ==============================
kind         a value counts when                                kept as it is
============ ================================================== ==============================
email        name and dotted domain                             domain, signs of the name
phone        ten digits after a country code; without one,      country code, punctuation
             area and exchange from 200 up
card         13 to 19 digits with a right Luhn sum              first digit, punctuation
iban         right remainder modulo 97                          country, letter/digit places
ipv4         four numbers up to 255, no leading zero            -
ssn          valid area, group and serial                       hyphens
date         a day of 1900 to 2099                              order and punctuation
secret       the value after token, password, secret or         prefix, letter/digit places
             api_key, or an access key id
============ ================================================== ==============================

Check digits of cards and IBANs are computed anew. Dates as ``2001-02-03`` or ``03.02.2001``
are permuted over all days of the range; dates with slashes, whose order may be unclear, are
permuted so that they stay valid in each order they could be read in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import text_or_empty

ROUNDS = 10
#: Hex digits of the round digest that one position uses, and positions before they are reused.
SLOT, SLOTS = 6, 21
FIRST_DAY, DAYS, DAY_PARTS = "1900-01-01", 73_049, (17, 4_297)  # 17 x 4,297 = 73,049 days up to 2099-12-31

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: One pattern a kind. Each is anchored on both sides, so that a value is taken whole or not at all.
PATTERNS = {
    "email": r"(?<![\w.%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "secret": r"(?<![A-Za-z0-9])(?:(?:[Tt]oken|[Pp]assword|[Ss]ecret|[Aa]pi_?[Kk]ey)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9]{8,}+|AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\w./\-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/\-]|\.\d)",
    "ipv4": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}|(?:\([2-9]\d{2}\)|[2-9]\d{2})[ .\-]?[2-9]\d{2})[ .\-]?\d{4}(?!\w)",
    "card": r"(?<!\w)\d(?:[ \-]?\d){12,18}(?!\w)",
}
ANY = "|".join(PATTERNS.values())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _ints(digits: Column) -> Column:
    return F.transform(_chars(digits), lambda c: c.try_cast("int"))


def feistel(values: Column, radix: Column, kind: str, key: str, rounds: int = ROUNDS) -> Column:
    """Keyed permutation of an int array in which position i stays below ``radix[i]``.

    The first and the second half take turns: each position of one half is shifted, modulo its
    radix, by a number drawn from the digest of (key, kind, length, round, other half).
    """
    def one_round(state: Column, j: Column) -> Column:
        half = F.size(state).cast("int") / 2
        in_first = lambda i: (i < F.floor(half)) == (j % 2 == 0)
        other = F.filter(state, lambda x, i: ~in_first(i))
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), F.size(state).cast("string"), j.cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)

        def shifted(hexes: Column) -> Column:
            draw = lambda i: F.conv(F.substring(hexes, 1 + SLOT * (i % SLOTS), F.lit(SLOT)), 16, 10).cast("int")
            return F.transform(state, lambda x, i: F.when(in_first(i), (x + draw(i)) % F.element_at(radix, i + 1)).otherwise(x).cast("int"))

        return _let(digest, shifted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), values, one_round)


def _permuted_text(text: Column, kind: str, key: str, letters: int = 26) -> Column:
    """Digits stay digits, small letters small and capitals capital; all else is fixed.

    ``letters=6`` keeps hexadecimal texts hexadecimal.
    """
    base = lambda c: F.when(c.rlike("[0-9]"), F.lit(48)).when(c.rlike("[A-Z]"), F.lit(65)).otherwise(F.lit(97))
    own = F.filter(_chars(text), lambda c: c.rlike("[0-9A-Za-z]"))
    values = F.transform(own, lambda c: (F.ascii(c) - base(c)).cast("int"))
    radix = F.transform(own, lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).when(c.rlike("[A-Z]"), F.lit(26)).otherwise(F.lit(letters)))
    new = lambda moved: F.transform(moved, lambda x, i: F.char(x + base(F.element_at(own, i + 1))))
    return _let(feistel(values, radix, kind, key), lambda moved: _poured(text, new(moved), "[0-9A-Za-z]"))


def _poured(text: Column, chars: Column, where: str) -> Column:
    """``text`` with its characters of class ``where`` replaced one by one by ``chars``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(state: Column, c: Column) -> Column:
        takes = c.rlike(where)
        return F.struct(
            F.concat(state["out"], F.when(takes, F.element_at(chars, state["k"] + 1)).otherwise(c)).alias("out"),
            (state["k"] + takes.cast("int")).alias("k"),
        )

    return F.aggregate(_chars(text), start, step, lambda state: state["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    def weighed(d: Column, i: Column) -> Column:
        twice = d * (1 + i % 2)
        return twice - F.when(twice > 9, F.lit(9)).otherwise(F.lit(0))

    return F.aggregate(F.transform(_ints(F.reverse(digits)), weighed), F.lit(0), lambda a, x: (a + x).cast("int")) % 10


def _card(text: Column, key: str) -> Column:
    def moved(digits: Column) -> Column:
        inner = _ints(F.substring(digits, F.lit(2), F.length(digits) - 2))
        body = lambda new: F.concat(F.substring(digits, 1, 1), F.array_join(new.cast("array<string>"), ""))
        full = _let(feistel(inner, F.transform(inner, lambda _: F.lit(10)), "card", key), lambda new: _let(
            body(new), lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string"))))
        return F.when(_luhn(digits) == 0, _let(_chars(full), lambda chars: _poured(text, chars, "[0-9]"))).otherwise(text)

    return _let(_digits(text), moved)


def _phone(text: Column, key: str) -> Column:
    def moved(digits: Column) -> Column:
        number = _ints(F.substring(digits, -10, 10))
        # the first digits of area and exchange stay below 2, or from 2 up, as they were
        high = lambda d, i: i.isin(0, 3) & (d >= 2)
        base = lambda d, i: F.when(high(d, i), F.lit(2)).otherwise(F.lit(0))
        values = F.transform(number, lambda d, i: d - base(d, i))
        radix = F.transform(number, lambda d, i: F.when(high(d, i), F.lit(8)).when(i.isin(0, 3), F.lit(2)).otherwise(F.lit(10)))
        new = _let(feistel(values, radix, "phone", key), lambda v: F.array_join(
            F.transform(v, lambda d, i: (d + base(F.element_at(number, i + 1), i)).cast("string")), ""))
        country = F.substring(digits, F.lit(1), F.length(digits) - 10)
        return _let(_chars(F.concat(country, new)), lambda chars: _poured(text, chars, "[0-9]"))

    return _let(_digits(text), moved)


def _ipv4(text: Column, key: str) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda c: c.try_cast("int"))
    return F.array_join(feistel(octets, F.array_repeat(F.lit(256), 4), "ipv4", key).cast("array<string>"), ".")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _ssn(text: Column, key: str) -> Column:
    area, group, serial = (F.split(text, "-")[i].try_cast("int") for i in range(3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, F.lit(1)).otherwise(F.lit(0))  # 898 areas
    new = feistel(F.array(place, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key)
    back = lambda v: F.concat_ws("-", _padded(v[0] + 1 + F.when(v[0] >= 665, F.lit(1)).otherwise(F.lit(0)), 3), _padded(v[1] + 1, 2), _padded(v[2] + 1, 4))
    return F.when(valid, _let(new, back)).otherwise(text)


def _remainder97(text: Column) -> Column:
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def step(a: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return ((a * F.when(letter, F.lit(100)).otherwise(F.lit(10)) + F.when(letter, F.ascii(c) - 55).otherwise(c.try_cast("int"))) % 97).cast("int")

    return F.aggregate(_chars(moved), F.lit(0), step)


def _iban(text: Column, key: str) -> Column:
    def moved(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        new = _let(_permuted_text(account, "iban", key), lambda a: F.concat(
            country, _padded(98 - _remainder97(F.concat(country, F.lit("00"), a)), 2), a))
        return F.when(_remainder97(plain) == 1, _let(_chars(new), lambda chars: _poured(text, chars, "[0-9A-Z]"))).otherwise(text)

    return _let(F.regexp_replace(text, " ", ""), moved)


def _date(text: Column, key: str) -> Column:
    """A slashed date belongs to the class of its larger part; the permutation stays inside it."""
    iso, dotted = text.rlike("^....-"), text.contains(".")
    day = F.when(iso, F.try_to_date(text, "yyyy-MM-dd")).otherwise(F.try_to_date(text, "dd.MM.yyyy"))
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    whole = _let(
        feistel(F.array(F.floor(number / DAY_PARTS[1]).cast("int"), number % DAY_PARTS[1]), F.array(*map(F.lit, DAY_PARTS)), "date", key),
        lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v[0] * DAY_PARTS[1] + v[1]))
    by_day = F.when((number >= 0) & (number < DAYS), F.when(iso, F.date_format(whole, "yyyy-MM-dd")).otherwise(F.date_format(whole, "dd.MM.yyyy")))

    one, two, year = (F.split(text, "/")[i].try_cast("int") for i in range(3))
    large, small, day_first = F.greatest(one, two), F.least(one, two), one > 12
    months = F.when(large == 31, F.array(*[F.lit(m) for m in (1, 3, 5, 7, 8, 10, 12)])).otherwise(F.array(*[F.lit(m) for m in (1, *range(3, 13))]))
    valid = (year >= 1900) & (year <= 2099) & (small >= 1) & (large <= 31)

    def slashed(a: Column, b: Column, y: Column) -> Column:
        return F.concat_ws("/", _padded(a, 2), _padded(b, 2), y.cast("string"))

    def ordered(d: Column, m: Column, y: Column) -> Column:
        return F.when(day_first, slashed(d, m, y)).otherwise(slashed(m, d, y))

    unclear = _let(feistel(F.array(one - 1, two - 1, year - 1900), F.array(F.lit(12), F.lit(12), F.lit(200)), "date12", key),
                   lambda v: slashed(v[0] + 1, v[1] + 1, v[2] + 1900))
    usual = _let(feistel(F.array(large - 13, small - 1, year - 1900), F.array(F.lit(16), F.lit(12), F.lit(200)), "date28", key),
                 lambda v: ordered(v[0] + 13, v[1] + 1, v[2] + 1900))
    late = _let(feistel(F.array(F.array_position(months, small).cast("int") - 1, year - 1900), F.array(F.size(months), F.lit(200)), "date31", key),
                lambda v: ordered(large, F.element_at(months, v[0] + 1), v[1] + 1900))
    leap = _let(feistel(F.array(F.floor((year - 1904) / 4).cast("int")), F.array(F.lit(49)), "date29", key), lambda v: ordered(large, small, 1904 + 4 * v[0]))
    is_leap = (year % 4 == 0) & (year != 1900)
    by_parts = (
        F.when(~valid, text).when(large <= 12, unclear).when(large <= 28, usual)
        .when((large == 29) & (small == 2), F.when(is_leap, leap).otherwise(text))
        .when(F.array_contains(months, small), late).otherwise(text)
    )
    return F.coalesce(F.when(iso | dotted, by_day).otherwise(by_parts), text)


def _email(text: Column, key: str) -> Column:
    name = F.substring_index(text, "@", 1)
    return F.concat(_permuted_text(name, "email", key), F.substring(text, F.length(name) + 1, F.length(text)))


def _secret(text: Column, key: str) -> Column:
    value = F.regexp_extract(text, r"(?:^AKIA|[=:]\s{0,3}[\"']?)([A-Za-z0-9]+)$", 1)
    prefix = F.substring(text, F.lit(1), F.length(text) - F.length(value))
    hexadecimal = value.rlike("^[0-9a-f]+$")
    moved = F.when(hexadecimal, _permuted_text(value, "hex", key, letters=6)).otherwise(_permuted_text(value, "secret", key))
    return F.concat(prefix, moved)


RULES = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one matched value; the value itself where its check fails."""
    chosen = reduce(lambda case, kind: case.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), RULES[kind](value, key)), list(RULES)[1:],
                    F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), _email(value, key)))
    return F.coalesce(chosen, value)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every valid personal value of ``text_col`` replaced by its pseudonym.

    ``count_col`` adds the number of values that were replaced. A null text stays null (count 0),
    an empty one stays empty; texts without such values, also very long ones, come back unchanged.
    Repeated rows and equal values get equal results. All other columns are carried along.
    """
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(ANY), 0)
    temp = "_pseudonyms"
    rewritten = docs.withColumn(temp, found).withColumn(temp, F.when(F.size(temp) > 0, F.transform(
        temp, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))))
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(
        pieces, F.col(temp), lambda piece, value: F.array(piece, F.coalesce(value["new"], F.lit(""))))), "")
    out = rewritten.withColumn(text_col, F.when(F.col(temp).isNotNull(), joined).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.size(F.filter(temp, lambda v: v["old"] != v["new"])), F.lit(0)).cast("long"))
    return out.drop(temp)
