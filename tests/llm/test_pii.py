from __future__ import annotations

import datetime
import hashlib
import re

import pytest
from text_cases import LONG, ODD, SCHEMA, table
from pyspark.sql import functions as F

from tidetrace.llm import pii

KEY = "k"


def number(*seed):
    return int(hashlib.md5("|".join(map(str, seed)).encode()).hexdigest()[:8], 16)


def moved(char, by):
    for low, size in ((48, 10), (65, 26), (97, 26)):
        if low <= ord(char) < low + size:
            return chr((ord(char) - low + by) % size + low)
    return char


def characters(value, kind, back=False):
    half = -(-len(value) // 2)
    a, b = value[:half], value[half:]
    turn = lambda x, y, n: "".join(
        moved(c, (-1 if back else 1) * number(f"{KEY}|{kind}", n, j, y)) for j, c in enumerate(x, 1)
    )
    for n in sorted(range(pii.ROUNDS), reverse=back):
        a, b = (turn(a, b, n), b) if n % 2 == 0 else (a, turn(b, a, n))
    return a + b


def pair(a, b, sizes, kind, back=False):
    sign = -1 if back else 1
    for n in sorted(range(pii.ROUNDS), reverse=back):
        if n % 2 == 0:
            a = (a + sign * number(f"{KEY}|{kind}", n, b)) % sizes[0]
        else:
            b = (b + sign * number(f"{KEY}|{kind}", n, a)) % sizes[1]
    return a, b


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def run(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [(r.text, r.n_pseudonyms) for r in pii.pseudonymise(rows, KEY).orderBy("i").collect()]


def test_cards_keep_their_check_digit_and_come_back(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005"]
    made = run(spark, [f"x {c}, y" for c in cards])
    for card, (text, n) in zip(cards, made):
        new = text[2:-3]
        digits = re.sub(r"\D", "", new)
        assert n == 1 and luhn(digits) == 0 and new != card
        assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", card)
        assert characters(digits[:-1], "card", back=True) == re.sub(r"\D", "", card)[:-1]
    assert len({re.sub(r"\D", "", t) for t, _ in made[:3]}) == 1
    assert run(spark, ["4111111111111112", "a4111111111111111"]) == [("4111111111111112", 0), ("a4111111111111111", 0)]


def test_dates(spark):
    first = datetime.date.fromisoformat(pii.FIRST_DAY)

    def expected(day):
        a, b = pair(*divmod((day - first).days, pii.DAY_PAIR[1]), pii.DAY_PAIR, "date")
        return first + datetime.timedelta(a * pii.DAY_PAIR[1] + b)

    day, year_end = datetime.date(2020, 2, 29), datetime.date(1999, 12, 31)
    made = run(spark, ["2020-02-29", "29/02/2020", "29.02.2020", "12/31/1999", "2021-02-29", "1899-12-31", "2099-12-31"])
    new = expected(day)
    assert [t for t, _ in made[:3]] == [new.isoformat(), new.strftime("%d/%m/%Y"), new.strftime("%d.%m.%Y")]
    assert made[3] == (expected(year_end).strftime("%m/%d/%Y"), 1)
    assert made[4:6] == [("2021-02-29", 0), ("1899-12-31", 0)] and made[6][1] == 1
    size = pii.DAY_PAIR[0] * pii.DAY_PAIR[1]
    assert size == (datetime.date(2100, 1, 2) - first).days
    seen = {pair(*divmod(i, pii.DAY_PAIR[1]), pii.DAY_PAIR, "date") for i in range(0, size, 7)}
    assert len(seen) == len(range(0, size, 7))
    assert pair(*pair(5, 6, pii.DAY_PAIR, "date"), pii.DAY_PAIR, "date", back=True) == (5, 6)


def test_other_kinds(spark):
    given = {
        "97.51.17.173": r"(\d{1,3}\.){3}\d{1,3}",
        "123-45-6789": r"\d{3}-\d{2}-\d{4}",
        "+1 (017) 555-7713": r"\+1 \(\d{3}\) \d{3}-\d{4}",
        "und.34@mail7.example.com": r"[a-z]{3}\.\d\d@mail7\.example\.com",
        "a@b.org": r"[a-z]@b\.org",
        "DE89370400440532013000": r"DE\d{20}",
        "GB82WEST12345698765432": r"GB\d{2}[A-Z]{4}\d{14}",
    }
    made = run(spark, [f"({v}). {v}" for v in given])
    for (value, form), (text, n) in zip(given.items(), made):
        one, two = re.fullmatch(r"\((.*)\)\. (.*)", text).groups()
        assert n == 2 and one == two != value and re.fullmatch(form, one), (value, text)
    for text, _ in made[5:]:
        account = text.split()[-1]
        assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    a, b = pair(97 * 256 + 51, 17 * 256 + 173, pii.IP_PAIR, "ip")
    assert made[0][0].split()[-1] == ".".join(map(str, (*divmod(a, 256), *divmod(b, 256))))
    assert all(0 <= int(p) <= 255 for p in made[0][0].split()[-1].split("."))
    for same in ("300.1.1.1", "01.2.3.4", "000-12-3456", "666-12-3456", "DE88370400440532013000", "1.2.3.4.5", "12", "a@b"):
        assert run(spark, [same]) == [(same, 0)]


def test_the_key_decides(spark):
    rows = spark.createDataFrame([("1.2.3.4",)], "text string")
    assert len({pii.pseudonymise(rows, k).first().text for k in ("a", "b", "c")}) == 3


def test_odd_rows(spark, tmp_path):
    rows = [*ODD, (7, LONG + " 1.2.3.4", "", "", 1)]
    docs = table(spark, rows, SCHEMA, tmp_path / "a").withColumn("n_pseudonyms", F.lit("clash")).withColumn("_found", F.lit(1))
    made = pii.pseudonymise(docs, KEY)
    assert made.columns == [*docs.columns, "n_pseudonyms_"]
    got = made.collect()
    assert {r.doc_id: r.text for r in got if r.doc_id not in (None, 7)} == {r[0]: r[1] for r in ODD if r[0]}
    (last,) = [r for r in got if r.doc_id == 7]
    assert last.text.startswith(LONG) and last.n_pseudonyms_ == 1 and not last.text.endswith(" 1.2.3.4")
    assert pii.pseudonymise(table(spark, [], SCHEMA, tmp_path / "b"), KEY).collect() == []


@pytest.mark.parametrize("value", ["ab", "a1", "Zz9", "abcdefghijkl0123456789XYZ"])
def test_characters_come_back(spark, value):
    got = spark.range(1).select(pii.permute_characters(F.lit(value), KEY, "x")).first()[0]
    assert got == characters(value, "x") and characters(got, "x", back=True) == value


def test_iban_check_digits_that_are_never_written(spark):
    """00, 01 and 99 leave the right remainder in place of 97, 98 and 02; such numbers stay, the others go."""
    written, never = [], []
    for account in range(10**13, 10**13 + 2000):
        digits = 98 - int(f"{account}131400") % 97
        if digits in (97, 98, 2):
            written.append(f"DE{digits:02d}{account}")
            never.append(f"DE{ {97: 0, 98: 1, 2: 99}[digits]:02d}{account}")
    assert len({x[2:4] for x in never}) == 3
    assert run(spark, never[:30]) == [(x, 0) for x in never[:30]]
    made = run(spark, written[:30])
    assert all(n == 1 and text != x for (text, n), x in zip(made, written)) and len({t for t, _ in made}) == 30
