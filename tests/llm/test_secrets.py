from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from text_cases import ODD, SCHEMA, table

from tidetrace.llm import secrets

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
    "hex": (re.compile(r"[0-9a-f]+"), 32, 0),
}


def brute(text):
    """The base spans by the patterns over the whole text."""
    found = []
    for order, (kind, (pattern, least, group)) in enumerate(BASE.items()):
        found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def token(prefix, body):
    rest, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, d = divmod(rest, 62)
        digits = secrets.BASE62[d] + digits
    return prefix + body + digits


def test_base_spans_of_random_texts():
    draw = random.Random(2)
    parts = [
        "token", "TOKEN=", 'Secret": "', "passwd", "password = ", "api_key:", "apikey=", "é", "İ", "ſecret=", " ", "\n", "abcdefgh",
        "abc", "AKIA", "AKIAABCDEFGHIJKL", "akia", "0123456789abcdef" * 2, "deadbeef", "A1", "-", "'", "=", "token=token=12345678",
    ]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        found = secrets.find_spans(text)
        assert [s for s in found if s[2] in BASE] == brute(text), text


def test_checksums():
    good = token("ghp_", "abcdefghijklmnopqrstuvwxyz0123")
    assert secrets.find_spans(f"é {good}.") == [(2, 42, "github")]
    assert secrets.find_spans(good[:-1] + ("0" if good[-1] != "0" else "1")) == []
    assert secrets.find_spans(token("npm_", "A" * 30)) == [(0, 40, "npm")]
    assert secrets.find_spans("-----BEGIN RSA PRIVATE KEY-----") == [(0, 31, "private_key")]
    assert secrets.find_spans("AIza" + "x" * 35) == [(0, 39, "google")]
    assert secrets.find_spans("ghp_short eyJ xoxb- sk_live_1") == []


@pytest.mark.parametrize("empty", [False, True])
def test_digest(spark, tmp_path, empty):
    key = 'token = "0123456789abcdef0123456789abcdef"'
    rows = [] if empty else [*ODD, (9, f"é {key}", "en", "a", 1), (10, "AKIA" + "B" * 12, "en", "a", 1)]
    got = secrets.digest(secrets.find_secrets(table(spark, rows, SCHEMA, tmp_path)))
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    if empty:
        return
    spans = f"assign:2:{2 + len(key) - 1},hex:11:43"
    assert by_id[9].spans == spans and by_id[9].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert (by_id[9].n_assign, by_id[9].n_access, by_id[9].n_hex) == (1, 0, 1) and by_id[10].spans == "access:0:16"
    assert by_id[2].base_sha256 == by_id[3].base_sha256 == hashlib.sha256(b"").hexdigest() and by_id[2].spans == ""
