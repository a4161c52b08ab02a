from __future__ import annotations

import gzip
import io
import random

import pytest
from text_cases import table
from pyspark.sql import functions as F

from tidetrace.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def pages():
    draw = random.Random(3)
    rows = [(i, f"http://h{i % 3}.example/ä b\r\n{i}", "".join(draw.choice("aé\r\n0 <") for _ in range(draw.randint(0, 900)))) for i in range(60)]
    rows += [(100 + i, None, "same\r\n\r\nWARC/1.1\r\n") for i in range(30)] + [(200, "u", None), (201, "u", ""), (202, None, "")]
    rows += [(300, "u", "x" * 200_000), (301, "u", "é" * 70_000), (None, "u", "only"), (None, "u", "same\r\n\r\nWARC/1.1\r\n")]
    return rows + [rows[0], rows[0]]


def brute(rows, least=0):
    """(id, bytes, digest, type, refers to) of each row; of equal rows one is the response."""
    first, out = {}, []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))):
        payload = (html or "").encode()
        digest = warc.payload_digest(payload)
        if len(payload) >= least and payload in first:
            out.append((page, len(payload), digest, "revisit", first[payload]))
        else:
            first.setdefault(payload, page)
            out.append((page, len(payload), digest, "response", None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "segment", "records"), [(0, 1 << 16, 4096), (20, 300, 5)])
def test_round_trip(spark, tmp_path, least, segment, records):
    given = table(spark, pages(), SCHEMA, tmp_path / "in").withColumn("digest", F.lit("clash")).withColumn("row", F.lit(1))
    warc.write_archives(given, f"{tmp_path}/out", least, segment, records)
    got = warc.read_pages(spark, f"{tmp_path}/out").withColumn("page", warc.page_id("record_id"))
    rows = got.withColumn("of", warc.page_id("refers_to")).collect()
    assert sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.of) for r in rows), key=str) == brute(pages(), least)
    texts = {}
    for page, _, html in pages():
        texts.setdefault(page, set()).add((html or "").encode())
    for r in rows:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or bytes(r.payload) in texts[r.page]
    every = warc.read_records(spark, f"{tmp_path}/out")
    continued = every.where("record_type = 'continuation'").count()
    assert (continued > 100) if segment == 300 else (0 < continued < 10)


def test_empty(spark, tmp_path):
    warc.write_archives(table(spark, [], SCHEMA, tmp_path / "in"), f"{tmp_path}/out")
    assert warc.read_pages(spark, f"{tmp_path}/out").collect() == []


def archive(records):
    return b"".join(r + b"\r\n\r\n" for r in records)


def test_faults(spark, tmp_path):
    payload = b"0123456789" * 50
    digest = warc.payload_digest(payload)
    whole = lambda name: warc.page_records(f"urn:x-page:{name}:0", "u", payload, digest, None, 160)
    assert len(whole(1)) == 4
    wrong = warc.page_records("urn:x-page:5:0", "u", payload, warc.payload_digest(b""), None)
    bad_total = [r.replace(b"Total-Length: ", b"Total-Length: 9") for r in whole(6)]
    records = [*reversed(whole(1)), *whole(2)[:3], whole(3)[0], *whole(3)[2:], *whole(4), whole(4)[1], *wrong, *bad_total]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(archive(records[:7]))
    (tmp_path / "a" / "y.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records[7:]))
    found = warc.decode(warc.reassemble(warc.read_records(spark, f"{tmp_path}/a")))
    faults = {r.record_id.split(":")[2]: r.fault for r in found.collect()}
    assert faults.pop("1") is None and all(faults.values()) and set(faults) == set("23456")
    with pytest.raises(Exception, match="faulty record"):
        warc.read_pages(spark, f"{tmp_path}/a").collect()


def test_segments_are_joined_in_proportion(spark):
    """A record of 20,000 segments in any order: each byte is copied once, where copies per segment would be 10 GB."""
    rows = spark.range(20_000).selectExpr(
        "concat('s', id) as record_id", "if(id = 0, 'response', 'continuation') as record_type", "'u' as uri",
        "cast(null as string) as refers_to", "cast(null as string) as payload_digest", "'o' as origin_id", "id + 1 as segment",
        "if(id = 19999, 1000000L, null) as total_length", "cast(repeat(char(65 + id % 26), 50) as binary) as block",
    )
    whole = warc.reassemble(rows.select(*warc._RECORDS.names).orderBy(F.rand(1))).first()
    assert whole.fault is None
    assert bytes(whole.block) == b"".join(bytes([65 + k % 26]) * 50 for k in range(20_000))


def test_chunks():
    assert warc.chunked(b"abcde", 2) == b"2\r\nab\r\n2\r\ncd\r\n1\r\ne\r\n0\r\n\r\n"
    assert warc.unchunked(b"2;x=1\r\nab\r\n0\r\nTrailer: t\r\n\r\n") == b"ab"
    for size in (1, 7, 100):
        assert warc.unchunked(warc.chunked(bytes(range(256)), size)) == bytes(range(256))
    for cut in (b"", b"2\r\na", b"2\r\nab\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(cut)
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(b"HTTP/1.1 200 OK\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
