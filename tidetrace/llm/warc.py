"""WARC archives: write pages with revisits and segments, read them back whole.

Writing: each payload is hashed; of the records with the same payload one is a response, the others are revisits that refer
to it and carry no body. A response is an HTTP message with a chunked body, cut into segments when it is long. Records are
written by Spark's text sink, whose line separator is the two line ends that close a WARC record.

Reading: archives are parsed record by record from a stream. Records in segments are grouped by their origin's identifier,
ordered by segment number and checked against the total length; then the chunked framing is decoded and the payload's digest
is checked. Only segments cross the cluster.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.llm.common import with_row_id, written

#: Bytes of a record's block from which it is cut; bytes of one chunk of a body.
SEGMENT_BYTES, CHUNK_BYTES = 1 << 16, 1 << 13
#: Records in one archive: with their limit in size, this bounds what one task holds of an archive.
ARCHIVE_RECORDS = 4096

_RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("origin_id", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("total_length", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base 32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing; an empty payload is the last chunk alone."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload in chunked framing; chunk extensions and trailers are passed over. Raises ValueError where it is cut off."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";", 1)[0], 16)
        if size == 0:
            return b"".join(parts)
        at = end + 2 + size + 2
        if body[at - 2 : at] != b"\r\n":
            raise ValueError("chunk cut off")
        parts.append(body[end + 2 : at - 2])


def _http_head(payload: bytes | int) -> bytes:
    """The head of a chunked response, or with a length that of the response a revisit stands for."""
    framing = b"Content-Length: %d" % payload if isinstance(payload, int) else b"Transfer-Encoding: chunked"
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + framing + b"\r\n\r\n"


def _record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    """A record without the two line ends after its block."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), *fields]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def _field(value: str | None) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), value or "")


def page_records(
    record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES
) -> list[bytes]:
    """The records of one page: a revisit, or a response and its continuations."""
    same = [("WARC-Target-URI", _field(uri)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    message = [("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = [*same, *message, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers_to}>")]
        return [_record("revisit", record_id, _http_head(len(payload)), fields)]
    block = _http_head(b"") + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record("response", record_id, block, [*same, *message])]
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    out = [_record("response", record_id, parts[0], [*same, *message, ("WARC-Segment-Number", "1")])]
    for n, part in enumerate(parts[1:], 2):
        fields = [same[0], ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record("continuation", f"{record_id}:{n}", part, fields))
    return out


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, records: int = ARCHIVE_RECORDS
) -> None:
    """Archive every row of ``pages``, a table (page_id, url, html), under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id is the response and the
    others revisit it; shorter payloads are all responses. A null html is an empty payload. A null page_id is the smallest.
    Of equal ids one row is chosen. Record ids name the page and the row, so that repeated rows are records of their own.
    An empty table writes archives without records.
    """
    rows = with_row_id(pages.select("page_id", "url", "html"), "row")
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = rows.withColumn("payload", payload).withColumn("digest", F.sha1("payload"))
    # short payloads are keyed by their row, so that they are no group
    rows = rows.withColumn("key", F.when(F.length("payload") >= least_bytes, F.col("digest")).otherwise(F.col("row").cast("string")))
    first = rows.groupBy("key").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n"))
    # a payload that occurs once needs no partner; a join of two tables can split the rows of one that many pages have
    shared = written(first.where("n > 1").select("key", "first"), "shared")
    joined = rows.join(shared, "key", "left")
    urn = lambda page, row: F.format_string("urn:x-page:%s:%s", F.coalesce(page.cast("string"), F.lit("")), row)
    original = F.when(F.col("row") != F.col("first.row"), urn(F.col("first.page_id"), F.col("first.row")))
    named = joined.select(urn(F.col("page_id"), F.col("row")).alias("record_id"), "url", "payload", "digest", original.alias("of"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record_id, uri, payload, digest, of in zip(*(c for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                found = page_records(record_id.as_py(), uri.as_py(), payload.as_py(), digest, of.as_py(), segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["record"])

    made = named.mapInArrow(archive, "record binary").select(F.col("record").cast("string").alias("value"))
    sink = made.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).option("compression", "gzip")
    sink.text(path)


def parse_archive(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of one archive, in order. Raises ValueError where an archive is cut off or isn't one."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:20]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("block cut off")
        bare = lambda name: (fields.get(name) or "").strip("<>") or None
        number = lambda name: int(fields[name]) if name in fields else None
        yield {
            "record_id": bare("warc-record-id"),
            "record_type": fields.get("warc-type"),
            "uri": fields.get("warc-target-uri"),
            "refers_to": bare("warc-refers-to"),
            "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "origin_id": bare("warc-segment-origin-id"),
            "segment": number("warc-segment-number"),
            "total_length": number("warc-segment-total-length"),
            "block": block,
        }


def read_records(spark: SparkSession, path: str, batch_bytes: int = 1 << 22) -> DataFrame:
    """Every record of the archives under ``path``, gzip or plain, as it stands there."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_RECORDS)
        for batch in batches:
            for content in batch.column(0):
                held = pa.BufferReader(content.as_buffer())
                packed = content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b"
                stream = io.BufferedReader(gzip.GzipFile(fileobj=held) if packed else held)
                rows, size = [], 0
                for record in parse_archive(stream):
                    rows.append(record)
                    size += len(record["block"])
                    if size > batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(parse, _RECORDS)


def _joined(records: DataFrame) -> DataFrame:
    """``records`` with ``block``, their ``blocks`` one after the other, each byte copied once."""
    at = records.columns.index("blocks")
    schema = T.StructType([f if f.name != "blocks" else T.StructField("block", T.BinaryType()) for f in records.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                # the blocks of a record lie in a row already
                row = batch.slice(k, 1)
                blocks = row.column(at).flatten()
                columns = list(row.columns)
                columns[at] = pa.array([b"".join(x.as_buffer() for x in blocks)], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return records.mapInArrow(run, schema)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: those without a segment number as they are, the others from their segments.

    ``fault`` is null, or says that segments are missing or repeated, or that their length isn't the stated one. Segments of
    a record are brought together, which is one record's size.
    """
    single = records.where("segment is null").withColumn("fault", F.lit(None).cast("string"))
    parts = records.where("segment is not null").withColumn("origin_id", F.coalesce("origin_id", "record_id"))
    block = F.struct("segment", "block", "total_length", "record_type", "uri", "refers_to", "payload_digest")
    joined = parts.groupBy("origin_id").agg(F.sort_array(F.collect_list(block)).alias("parts"))
    total = F.array_max(F.transform("parts", lambda p: p.total_length))
    length = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p.block))
    gap = F.exists(F.transform("parts", lambda p, i: p.segment != i + 1), lambda x: x)
    fault = (
        F.when(gap, F.lit("segments are missing or repeated"))
        .when(total.isNull(), F.lit("the last segment is missing"))
        .when(length != total, F.lit("the length is not the stated one"))
    )
    head = F.col("parts")[0]
    joined = joined.select(
        F.col("origin_id").alias("record_id"),
        head.record_type.alias("record_type"),
        head.uri.alias("uri"),
        head.refers_to.alias("refers_to"),
        head.payload_digest.alias("payload_digest"),
        F.lit(None).cast("string").alias("origin_id"),
        F.lit(None).cast("bigint").alias("segment"),
        total.alias("total_length"),
        F.col("parts.block").alias("blocks"),
        fault.alias("fault"),
    )
    return single.unionByName(_joined(joined))


def decode(records: DataFrame) -> DataFrame:
    """``record_id, record_type, uri, refers_to, payload_bytes, payload_digest, payload, fault`` of whole records.

    A response's payload is its body, its framing decoded; its digest is computed and held against the stated one. A revisit
    has a null payload, and the length and digest it states. Faulty records keep a null payload and say why.
    """
    schema = T.StructType(
        [
            *(_RECORDS[c] for c in ("record_id", "record_type", "uri", "refers_to")),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_digest", T.StringType()),
            T.StructField("payload", T.BinaryType()),
            T.StructField("fault", T.StringType()),
        ]
    )

    def one(kind: str, stated: str | None, block: bytes, fault: str | None) -> tuple:
        head, end, body = block.partition(b"\r\n\r\n")
        if fault or not end:
            return None, stated, None, fault or "no HTTP head"
        fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
        if kind == "revisit":
            length = fields.get(b"content-length", b"").strip()
            return int(length) if length.isdigit() else None, stated, None, None
        try:
            payload = unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body
        except ValueError as error:
            return None, stated, None, str(error)
        digest = payload_digest(payload)
        return len(payload), digest, payload, None if stated in (None, digest) else "the digest is not the stated one"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 4, 5, 6)))  # type, digest, block, fault
            found = [one(*row) for row in rows]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.string())
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], schema.names)

    ready = records.select("record_id", "record_type", "uri", "refers_to", "payload_digest", "block", "fault")
    return ready.mapInArrow(run, schema)


def page_id(record_id: str, kind: str = "bigint"):
    """The page id in a record id that ``write_archives`` made; null for a null page_id."""
    return F.nullif(F.split_part(F.col(record_id), F.lit(":"), F.lit(3)), F.lit("")).cast(kind)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The decoded records of the archives under ``path``, without ``fault``: the read fails at a faulty record."""
    found = decode(reassemble(read_records(spark, path)))
    message = F.concat(F.lit("faulty record "), "record_id", F.lit(": "), "fault")
    sound = F.when(F.col("fault").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return found.where(sound).drop("fault")
