from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from docweave.llm.scratch import Scratch
from docweave.llm.warc import parse_records, read_warc, reassemble, resolved, unchunk, warc_round_trip, write_warc

from .common import clashing, edge_rows, frame, prose, repeated_rows

PAGES = "page_id long, url string, html string"


def pages():
    big = "<p>é" * 30_000
    return [(1, "http://a", "x" * 150), (2, "http://b", "x" * 150), (3, None, None), (4, "u", ""), (5, "u\r\nv", "short"), (6, "u", "short"), (7, "u", big), (8, "u", big), (9, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n" * 5), (10, "u", "0\r\n\r\n" * 2000), (11, "u", "y" * 99), (12, "u", "y" * 99), (13, "u", "🙂" * 40_000)]


def wanted(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        ref = first.get(b)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref is not None and ref != p else "response", ref if ref is not None and ref != p else None))
    return sorted(out)


def test_round_trip(spark):
    out = warc_round_trip(spark, clashing(spark.createDataFrame(pages(), PAGES).repartition(3))).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == wanted(pages())
    html = {p: (h or "").encode() for p, _, h in pages()}
    path = Scratch(spark, "t").path("w")
    write_warc(spark.createDataFrame(pages(), PAGES), path)
    read = read_warc(spark, path).collect()
    assert len(read) == len(html) and all(bytes(r["payload"]) == html[r["page_id"]] for r in read if r["record_type"] == "response")
    assert all(r["payload"] is None and r["refers_to_id"] in {x["record_id"] for x in read} for r in read if r["record_type"] == "revisit")


def test_empty_null_and_repeated_pages(spark):
    assert warc_round_trip(spark, spark.createDataFrame([], PAGES)).collect() == []
    rows = [(1, "u", "z" * 200), (1, "u", "z" * 200), (None, "u", "z" * 200), (None, None, None)]
    out = warc_round_trip(spark, spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(str((r["page_id"], r["record_type"], r["refers_to"])) for r in out) == sorted(map(str, [(1, "response", None), (1, "response", None), (None, "response", None), (None, "response", None)]))


def test_segments_are_real_and_checked(spark):
    path = Scratch(spark, "t").path("w")
    write_warc(spark.createDataFrame([(7, "u", prose(1, 40_000))], PAGES), path, segment_chars=10_000)
    import gzip

    raw = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").load(path).collect())
    records = list(parse_records(raw))
    assert len(records) > 10 and {h["warc-type"] for h, _, _ in records} == {"response", "continuation"}
    assert b"Transfer-Encoding: chunked" in records[0][1]
    assert bytes(read_warc(spark, path).collect()[0]["payload"]).decode() == prose(1, 40_000)


def _record(id_, kind, body, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": id_, "Content-Length": str(len(body))} | {k.replace("_", "-"): v for k, v in more.items()}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None) + b"\r\n" + body + b"\r\n\r\n"


def test_archives_of_others_and_faults_become_rows(spark, tmp_path):
    """Plain and gzip archives; records cut off, without a length or an id, broken gzip, revisits of nothing."""
    import gzip

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    a, b = _record("a", "response", http + b"one"), _record("b", "response", http + b"two")
    sha = hashlib.sha256(b"one").hexdigest()
    (tmp_path / "1.warc").write_bytes(a + b)
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(_record("c", "response", http + b"three")) + gzip.compress(_record("d", "revisit", http, WARC_Refers_To="a", WARC_Payload_Digest=f"sha256:{sha}")))
    (tmp_path / "3.warc").write_bytes(_record("e", "response", http + b"x") + _record("f", "response", http + b"cut off")[:-9])
    (tmp_path / "4.warc").write_bytes(_record("g", "response", http, Content_Length=None) + a)
    (tmp_path / "5.warc.gz").write_bytes(gzip.compress(_record("h", "response", http + b"h")) + gzip.compress(b)[:20])
    (tmp_path / "6.warc").write_bytes(b"no archive")
    (tmp_path / "7.warc").write_bytes(b"")
    (tmp_path / "8.warc").write_bytes(_record("i", "revisit", http, WARC_Refers_To="nowhere") + _record("j", "revisit", http, WARC_Refers_To="a", WARC_Payload_Digest="sha256:0") + _record(None, "response", http + b"z") + _record("k", "response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz") + _record("l", "response", http, WARC_Segment_Number="two") + _record("m", "response", http + b"m", WARC_Payload_Digest="sha256:1"))
    (tmp_path / "notes.md").write_bytes(a)
    out = {r["record_id"].rpartition("/")[2]: r for r in resolved(read_warc(spark, f"file://{tmp_path}"), Scratch(spark, "t")).collect()}
    good = {"a", "b", "c", "d", "e", "h"}
    assert {k for k, r in out.items() if r["error"] is None} == good
    assert set(out) - good == {"f", "g", "i", "j", "k", "l", "m", "5.warc.gz", "6.warc", "8.warc"}
    assert (out["d"]["payload_bytes"], out["d"]["payload_digest"]) == (3, sha) and out["h"]["payload_bytes"] == 1


def test_reassembly_errors():
    assert reassemble([(2, b"b", 2), (1, b"a", None)]) == b"ab"
    for bad in ([(1, b"a", None), (3, b"c", 2)], [(1, b"a", None), (2, b"b", 3)], [(1, b"a", None)], [(1, b"a", None), (1, b"a", 2)]):
        with pytest.raises(ValueError):
            reassemble(bad)
    assert unchunk(b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        unchunk(b"3\r\nabcd\r\n0\r\n\r\n")


@pytest.mark.parametrize("rows", [edge_rows(), repeated_rows(), []])
def test_pipeline_stages(spark, rows):
    docs = clashing(frame(spark, rows))
    for name, stage in corpus_pipeline.STAGES:
        out = Scratch(spark, "stage").stage(stage(spark, docs, ""), name)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        docs = out
    docs.collect()


def test_pipeline_decisions(spark):
    a, passage = prose(1, 200), prose(70, 60)
    rows = [(1, a, "en", "s1", 0), (2, a + " end", "en", "s2", 0), (3, prose(3, 150) + "\n" + passage, "en", "s3", 0), (4, prose(4, 150) + "\n" + passage, "en", "s4", 0), (5, "too short", "en", "s5", 0)]
    rows += [(20 + i, prose(20 + i, 150) + "\nAll rights reserved here.", "en", f"t{i}", 0) for i in range(12)]
    docs, seen = frame(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "stage").stage(stage(spark, docs, ""), name)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(seen["quality"]) == {1, 2, 3, 4, *range(20, 32)}
    assert not any("All rights" in t for t in seen["lines"].values())
    assert set(seen["neardup"]) == {1, 3, 4, *range(20, 32)}
    assert passage in seen["substrings"][3] and passage not in seen["substrings"][4]
