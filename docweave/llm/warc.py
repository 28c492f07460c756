"""WARC archives of web pages: writing, reading, segment reassembly.

Writing.  Each page is one record.  Of records with equal payloads (SHA-256) of
at least ``revisit_bytes`` bytes, that with the smallest page_id is a response
and the others revisit it without a body; smaller ones are all responses.  A
body over ``segment_bytes`` is cut: the first record has WARC-Segment-Number 1,
continuation records name it in WARC-Segment-Origin-ID and count on, the last
states WARC-Segment-Total-Length.  Long bodies are also framed in chunks
(Transfer-Encoding: chunked).  Spark's text writer makes the files, with
CRLF CRLF, the end of a WARC record, as its line separator; files are gzip members.

Reading.  Spark's binaryFile source opens the archives (``*.warc``, ``*.warc.gz`` and what is
written here) wherever they are; records
are cut by Content-Length.  Continuations are grouped by origin id, ordered by
segment number, checked for gaps and against the total length, joined, and then
taken out of their chunks.  Whatever does not add up becomes a row with an
``error`` instead of a payload: a record that is cut off or has no usable length or headers, a
broken gzip member (what comes before it is read), segments with gaps, wrong framing.  What
follows a record whose end is unknown is lost, up to the next file.  A revisit has no payload of its
own; ``resolved`` takes its length and digest from the response that it names.

Edge cases: a null html is an empty payload; a null url an empty target.  Pages
with a null page_id are responses of their own.  Repeated rows of one page_id
each come out, alike.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from .scratch import Scratch

REVISIT_BYTES = 100
SEGMENT_CHARS = 32_768
CHUNK_CHARS = 4096
RECORDS_PER_FILE = 2000
_END = "\r\n\r\n"


def _length(c: Column) -> Column:
    return F.octet_length(c).cast("string")


def _chunked(payload: Column) -> Column:
    """The payload in chunks of ``CHUNK_CHARS`` characters, ended by an empty one."""
    parts = F.transform(
        F.sequence(F.lit(0), F.ceil(F.char_length(payload) / CHUNK_CHARS).cast("int") - 1),
        lambda i: F.substring(payload, i * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)),
    )
    framed = F.transform(parts, lambda p: F.concat(F.lower(F.hex(F.octet_length(p).cast("long"))), F.lit("\r\n"), p, F.lit("\r\n")))
    return F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n"))


def assign_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, copy."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256), "row_id": F.monotonically_increasing_id()})
    # minimum by digest first, then a join: a digest of very many copies is reduced before it moves
    first = p.where((F.col("payload_bytes") >= revisit_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    p = p.join(first, "payload_digest", "left")
    # rows of one page and payload are numbered, on the join's own partitioning: ids come from values that any task finds again
    p = p.withColumn("copy", F.row_number().over(W.partitionBy("payload_digest", "page_id").orderBy("row_id"))).drop("row_id")
    revisit = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("payload_bytes") >= revisit_bytes) & (F.col("page_id") != F.col("first"))
    return p.withColumns({"record_type": F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))}).drop("first")


def record_texts(p: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The records as text, headers and block, without the closing CRLF CRLF."""
    is_response = F.col("record_type") == "response"
    long_body = F.char_length("html") > CHUNK_CHARS
    body = F.when(~is_response, F.lit("")).when(long_body, _chunked(F.col("html"))).otherwise(F.col("html"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(is_response & long_body, F.lit("Transfer-Encoding: chunked\r\n")).otherwise(F.concat(F.lit("Content-Length: "), _length(body), F.lit("\r\n"))), F.lit("\r\n"))
    p = p.withColumn("block", F.concat(http, body))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.char_length("block") / segment_chars).cast("int") - 1), lambda i: F.substring(F.col("block"), i * segment_chars + 1, F.lit(segment_chars)))
    p = p.withColumn("total", F.octet_length("block")).select("*", F.posexplode(pieces).alias("at", "piece"), F.ceil(F.char_length("block") / segment_chars).alias("pieces")).drop("html", "block")
    # the id comes from the row, so a task that runs again writes the same records
    def urn(part: Column, page: str = "page_id", copy: Column = F.col("copy")) -> Column:
        h = F.md5(F.concat_ws(":", F.col("payload_digest"), F.coalesce(F.col(page).cast("string"), F.lit("")), copy.cast("string"), part.cast("string")))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))

    first, several = F.col("at") == 0, F.col("pieces") > 1
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(first, F.col("record_type")).otherwise("continuation")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("at"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", " ")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
        F.when(first, F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"))),
        F.when(first & F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.lit(0), "refers_to", F.lit(1)))),
        F.when(several, F.concat(F.lit("WARC-Segment-Number: "), (F.col("at") + 1).cast("string"))),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: "), urn(F.lit(0)))),
        F.when(several & (F.col("at") == F.col("pieces") - 1), F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), _length(F.col("piece"))),
    ]
    return p.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("piece")).alias("value"))


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, segment_chars: int = SEGMENT_CHARS) -> None:
    records = record_texts(assign_records(pages, revisit_bytes), segment_chars)
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def inflate(data: bytes) -> tuple[bytes, str | None]:
    """The bytes of all gzip members, as far as they can be read, and what is wrong with the rest."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error as e:
            return b"".join(out), f"gzip: {e}"
        if not member.eof:
            return b"".join(out), "gzip: the last member is cut off"
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out), None


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """(headers with lower-case names, block, fault) of each record of an uncompressed archive; after a fault there are no more."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            yield {}, None, f"no WARC record at byte {at}"
            return
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode(errors="replace").strip().lower()] = value.decode(errors="replace").strip()
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield headers, None, f"the record at byte {at} has no length"
            return
        block = data[end + 4 : end + 4 + int(length)]
        if len(block) != int(length):
            yield headers, None, f"the record at byte {at} is cut off"
            return
        yield headers, block, None
        at = end + 4 + len(block)


def unchunk(body: bytes) -> bytes:
    """Takes the chunked transfer framing off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size < 0:
            raise ValueError(f"chunk at byte {at} has a negative size")
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError(f"chunk at byte {at} does not end where it says")
        out.append(body[at : at + size])
        at += size + 2


def reassemble(segments: list[tuple[int, bytes, int | None]]) -> bytes:
    """The whole block from (number, bytes, total length or none) in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError(f"segments {[s[0] for s in segments][:20]} leave gaps or repeat")
    total = segments[-1][2]
    block = b"".join(s[1] for s in segments)
    if total is None or total != len(block):
        raise ValueError(f"segments hold {len(block)} bytes; the last states {total}")
    return block


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower():
            return unchunk(body)
    return body


_RECORD_SQL = "record_id string, kind string, page_id long, url string, digest string, refers_to_id string, number long, total long, payload binary, error string"
_RECORD = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to_id", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and x.lstrip("-").isdigit() and x.isascii() and len(x) < 19 else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (path, content): records, those in segments still cut."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)

    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            data, broken = content.as_py() or b"", None
            if data[:2] == b"\x1f\x8b":
                data, broken = inflate(data)
            rows, held, fault = [], 0, None
            for h, block, fault in parse_records(data):
                number, error = _number(h.get("warc-segment-number")), fault
                if error is None and h.get("warc-record-id") is None:
                    error = "a record without an id"
                if "warc-segment-number" in h and number is None:
                    error = error or f"segment number `{h['warc-segment-number']}`"
                if error is not None:
                    number, block = None, None
                elif number is None:  # whole: its payload comes out here, and never moves with others
                    try:
                        block = payload_of(block)
                    except ValueError as e:
                        block, error = None, str(e)
                digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                rows.append((h.get("warc-segment-origin-id", h.get("warc-record-id", path.as_py())), h.get("warc-type"), _number(h.get("x-page-id")), h.get("warc-target-uri"), digest, h.get("warc-refers-to"), number, _number(h.get("warc-segment-total-length")), block, error))
                held += len(block or b"")
                if held > 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if broken is not None and fault is None:  # else the record that it cuts says so
                rows.append((path.as_py(), None, None, None, None, None, None, None, None, broken))
            if rows:
                yield batch(rows)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments sorted by (origin, number): one whole record each."""
    held: list[dict] = []

    def whole() -> pa.RecordBatch:
        first = dict(min(held, key=lambda r: r["number"]))
        try:
            first["payload"] = payload_of(reassemble([(r["number"], r["payload"], r["total"]) for r in held]))
        except ValueError as e:
            first["payload"], first["error"] = None, str(e)
        return pa.RecordBatch.from_pylist([first], schema=_RECORD)

    for b in batches:
        for lo in range(0, b.num_rows, 64):
            for r in b.slice(lo, 64).to_pylist():
                if held and held[0]["record_id"] != r["record_id"]:
                    yield whole()
                    held = []
                held.append(r)
    if held:
        yield whole()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``, segments joined.

    record_id, record_type, page_id, url, payload_digest as stated, refers_to_id (the record that a
    revisit names), payload (null for revisits), error.  A fault that belongs to no record has its file's path as record_id.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz,txt,txt.gz}").load(path).select("path", "content")
    records = files.mapInArrow(_read, _RECORD_SQL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = records.where("number is not null").repartition(parts, "record_id").sortWithinPartitions("record_id", "number").mapInArrow(_join_segments, _RECORD_SQL)
    out = records.where("number is null").unionByName(cut)
    payload = F.when(F.coalesce(F.col("kind") != "revisit", F.lit(True)), F.col("payload"))
    return out.select("record_id", F.col("kind").alias("record_type"), "page_id", "url", F.col("digest").alias("payload_digest"), "refers_to_id", payload.alias("payload"), "error")


def resolved(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``records`` of ``read_warc`` without their payloads: record_id, page_id, url, record_type, refers_to, payload_bytes, payload_digest, error.

    A response's length and digest are those of its payload, a revisit's those of the
    response that it names.  A payload that is not what its record states, and a revisit whose response is not
    there or has another digest, are errors.  The archives are read once.
    """
    own = records.select("record_id", "record_type", "page_id", "url", "refers_to_id", F.col("payload_digest").alias("stated"), F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "error")
    own = scratch.stage(own, "records")
    differs = F.when(F.col("stated").isNotNull() & (F.col("stated") != F.col("payload_digest")), F.lit("payload differs from its digest"))
    whole = own.where("record_type is null or record_type <> 'revisit' or error is not null")
    whole = whole.select("record_id", "page_id", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest", F.coalesce("error", differs).alias("error"))
    revisits = own.where("record_type = 'revisit' and error is null").select("record_id", "page_id", "url", "record_type", "refers_to_id", "stated")
    # the responses that are named, each once however many revisit it
    named = revisits.select(F.col("refers_to_id").alias("named")).distinct()
    responses = own.where("record_type = 'response' and error is null").join(named, F.col("record_id") == F.col("named"), "left_semi")
    responses = responses.select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    found = revisits.join(responses, F.col("refers_to_id") == F.col("named"), "left")
    missing = F.when(F.col("named").isNull(), F.lit("the response that it names is not there"))
    return whole.unionByName(found.select("record_id", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", F.coalesce(missing, differs).alias("error")))


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back, revisits resolved: the columns of ``resolved`` but error.

    An unreadable record, one whose payload is not what it states, and a revisit of nothing raise.
    """
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_warc(pages, path)
    read = resolved(read_warc(spark, path), scratch)
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("WARC record "), F.col("record_id"), F.lit(": "), F.col("error"))).cast("string")).otherwise(F.col("payload_digest"))
    return read.withColumn("payload_digest", checked).drop("error")
