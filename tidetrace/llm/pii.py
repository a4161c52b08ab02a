"""Pseudonyms that keep the format of what they stand for.

Numbers and dates that pass their kind's check, and the names in mail addresses, are permuted by a keyed Feistel network
within their format: a card number becomes another with a right check digit, a date another date written the same way. The
permutation depends on the key and the kind only, so equal values have equal pseudonyms in all documents, and different
values different ones. Everything is SQL expressions over a row; nothing is shuffled.

Two networks serve all kinds. Characters: the halves of a string take turns, each of its letters and digits is moved within
its class by a keyed hash of the other half. Pairs: a value is a pair (a, b) below (A, B), and a and b take turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import free_name

ROUNDS = 8

# How the kinds are written.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])(?:(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())

#: Dates are permuted among 1900-01-01 to 2100-01-01: 73,050 days, 150 x 487.
FIRST_DAY, DAY_PAIR = "1900-01-01", (150, 487)
#: Areas 1 to 899 without 666; groups 1 to 99 with serials 1 to 9999.
SSN_PAIR = (898, 99 * 9999)
IP_PAIR = (1 << 16, 1 << 16)


def _number(*seed: Column) -> Column:
    """A keyed number below 2^32."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(s.cast("string") for s in seed))), 1, 8), 16, 10).cast("bigint")


def _moved(char: Column, by: Column) -> Column:
    """A letter or digit ``by`` places further in its class; other characters stay."""
    code = F.ascii(char)
    out = char
    for low, size in ((48, 10), (65, 26), (97, 26)):
        out = F.when(code.between(low, low + size - 1), F.char((code - low + by) % size + low)).otherwise(out)
    return out


def permute_characters(value: Column, key: str, kind: str) -> Column:
    """A permutation of the strings with the same classes of characters in the same places, for 2 characters or more."""
    half = F.ceil(F.length(value) / 2).cast("int")
    seed = F.lit(f"{key}|{kind}")

    def turn(half: Column, other: Column, n: Column) -> Column:
        moved = F.transform(
            F.sequence(F.lit(1), F.length(half)), lambda j: _moved(F.substring(half, j, F.lit(1)), _number(seed, n, j, other))
        )
        return F.array_join(moved, "")

    def step(state: Column, n: Column) -> Column:
        left = F.struct(turn(state.a, state.b, n).alias("a"), state.b.alias("b"))
        return F.when(n % 2 == 0, left).otherwise(F.struct(state.a.alias("a"), turn(state.b, state.a, n).alias("b")))

    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    numbers = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(numbers, start, step, lambda s: F.concat(s.a, s.b))


def permute_pair(a: Column, b: Column, sizes: tuple[int, int], key: str, kind: str, finish: Callable[[Column], Column]) -> Column:
    """``finish`` of (a, b) permuted among all pairs below ``sizes``."""
    seed = F.lit(f"{key}|{kind}")

    def step(state: Column, n: Column) -> Column:
        first = F.struct(((state.a + _number(seed, n, state.b)) % sizes[0]).alias("a"), state.b.alias("b"))
        second = F.struct(state.a.alias("a"), ((state.b + _number(seed, n, state.a)) % sizes[1]).alias("b"))
        return F.when(n % 2 == 0, first).otherwise(second)

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, finish)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits`` in order."""
    char = lambda i: F.substring(value, i, F.lit(1))
    nth = lambda i: F.length(_digits(F.substring(value, F.lit(1), i)))
    filled = F.transform(
        F.sequence(F.lit(1), F.length(value)),
        lambda i: F.when(char(i).between("0", "9"), F.substring(digits, nth(i), F.lit(1))).otherwise(char(i)),
    )
    return F.array_join(filled, "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits of which the last is a check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _mod97(account: Column) -> Column:
    """An IBAN's remainder: letters are two digits, the first four characters come last."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _mail(value: Column, key: str) -> tuple[Column, Column]:
    name = F.substring_index(value, "@", 1)
    host = F.substring(value, F.length(name) + 1, F.length(value))
    # a name of one character has no halves: it is moved by what the key says of its kind
    single = _moved(name, _number(F.lit(f"{key}|mail")))
    return F.lit(True), F.concat(F.when(F.length(name) > 1, permute_characters(name, key, "mail")).otherwise(single), host)


def _iban(value: Column, key: str) -> tuple[Column, Column]:
    country = F.substring(value, 1, 2)
    rest = permute_characters(F.substring(value, F.lit(5), F.length(value)), key, "iban")
    checked = lambda made: F.concat(
        country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), made))).cast("string"), 2, "0"), made
    )
    # 00, 01 and 99 leave the remainder of 97, 98 and 02 but are never written
    digits = F.substring(value, 3, 2)
    return (_mod97(value) == 1) & digits.between("02", "98"), F.element_at(F.transform(F.array(rest), checked), 1)


def _ip(value: Column, key: str) -> tuple[Column, Column]:
    part = F.transform(F.split(value, r"\."), lambda p: p.cast("int"))
    good = F.forall(F.split(value, r"\."), lambda p: (p.cast("int") <= 255) & (p.cast("int").cast("string") == p))
    pair = part[0] * 256 + part[1], part[2] * 256 + part[3]
    quad = lambda s: F.concat_ws(".", *(x.cast("string") for h in (s.a, s.b) for x in (F.floor(h / 256), h % 256)))
    return good, permute_pair(*pair, IP_PAIR, key, "ip", quad)


def _date(value: Column, key: str) -> tuple[Column, Column]:
    """Year first, day first, or where that is no date, month first."""
    year_first = value.substr(5, 1) == "-"
    digits = _digits(value)
    day = lambda y, m, d: F.concat_ws("-", *(F.substring(digits, *p) for p in (y, m, d))).try_cast("date")
    by_year, by_day, by_month = (day(*p) for p in (((1, 4), (5, 2), (7, 2)), ((5, 4), (3, 2), (1, 2)), ((5, 4), (1, 2), (3, 2))))
    when = F.when(year_first, by_year).otherwise(F.coalesce(by_day, by_month))
    n = F.date_diff(when, F.lit(FIRST_DAY).cast("date"))
    size = DAY_PAIR[0] * DAY_PAIR[1]
    form = F.when(year_first, F.lit("yyyyMMdd")).when(by_day.isNotNull(), F.lit("ddMMyyyy")).otherwise(F.lit("MMddyyyy"))
    written = lambda s: F.date_format(
        F.date_add(F.lit(FIRST_DAY).cast("date"), (s.a * DAY_PAIR[1] + s.b).cast("int")), "yyyyMMdd"
    )
    plain = permute_pair(F.floor(n / DAY_PAIR[1]), n % DAY_PAIR[1], DAY_PAIR, key, "date", written)
    y, m, d = (F.substring(plain, *p) for p in ((1, 4), (5, 2), (7, 2)))
    ordered = F.when(form == "yyyyMMdd", plain).when(form == "ddMMyyyy", F.concat(d, m, y)).otherwise(F.concat(m, d, y))
    return n.isNotNull() & (n >= 0) & (n < size), _refill(value, ordered)


def _ssn(value: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(value, *p).cast("int") for p in ((1, 3), (5, 2), (8, 4)))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def written(s: Column) -> Column:
        area = F.when(s.a >= 665, s.a + 2).otherwise(s.a + 1)
        return F.format_string("%03d-%02d-%04d", area, F.floor(s.b / 9999) + 1, s.b % 9999 + 1)

    return good, permute_pair(place, (group - 1) * 9999 + serial - 1, SSN_PAIR, key, "ssn", written)


def _card(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    made = permute_characters(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = lambda m: F.concat(m, ((10 - _luhn(F.concat(m, F.lit("0"))) % 10) % 10).cast("string"))
    return _luhn(digits) % 10 == 0, _refill(value, F.element_at(F.transform(F.array(made), check), 1))


def _phone(value: Column, key: str) -> tuple[Column, Column]:
    """The country code stays: the 1 of +1, else as many digits after the plus as stand before the first separator, up to 3."""
    code = F.regexp_extract(value, r"^\+(1(?=[ .(-])|[0-9]{1,3}(?=[ .-])|[0-9]{1,2})", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    n = F.length(_digits(value))
    return n.between(7, 15), F.concat(code, _refill(rest, permute_characters(_digits(rest), key, "phone")))


_KINDS = {"mail": _mail, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def _by_kind(value: Column, key: str) -> Column:
    """(kind, pseudonym) of a match; both null where its kind's check fails."""
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"))
    out = none
    for kind in reversed(PATTERNS):
        valid, name = _KINDS[kind](value, key)
        named = F.struct(F.lit(kind).alias("kind"), name.alias("name"))
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.when(valid, named).otherwise(none)).otherwise(out)
    return out


def pseudonymise(documents: DataFrame, key: str, text: str = "text", counts: str = "n_pseudonyms") -> DataFrame:
    """``documents`` with pseudonyms in ``text``, and a column ``counts`` with how many.

    Matches are found from the left and don't overlap. What looks like a kind but fails its check stays as it is: a card number
    or IBAN with a wrong check digit, an address part above 255, a day that isn't in the calendar or before 1900 or after 2100-01-01. Dates
    written in different ways are linked as the same day. Null texts stay null and count 0. If a column is called ``counts``
    already, underscores are added to the new one.
    """
    found, parts, made = (free_name(documents, c) for c in ("_found", "_parts", "_made"))
    counts = free_name(documents, counts)
    some = F.col(text).rlike("[0-9@]")
    rows = documents.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    any_found = F.size(found) > 0
    rows = rows.withColumn(parts, F.when(any_found, F.split(text, ANY, -1)))
    rows = rows.withColumn(made, F.when(any_found, F.transform(found, lambda m: _by_kind(m, key))))
    names = F.transform(made, lambda m, i: F.coalesce(m["name"], F.element_at(found, i + 1)))
    joined = F.zip_with(parts, F.concat(names, F.array(F.lit(""))), lambda p, n: F.concat(p, n))
    new = F.when(any_found, F.array_join(joined, "")).otherwise(F.col(text))
    number = F.coalesce(F.size(F.filter(made, lambda m: m["kind"].isNotNull())), F.lit(0))
    number = F.when(any_found, number).otherwise(0).cast("bigint")
    return rows.withColumns({text: new, counts: number}).select(*documents.columns, counts)
