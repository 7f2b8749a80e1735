import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from holdfast.llm import warc

from .helpers import SF, clashing


def expected(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    counts = {}
    for _, _, h in rows:
        counts[(h or "").encode()] = counts.get((h or "").encode(), 0) + 1
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = len(p) >= 100 and counts[p] > 1 and p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response",
                    first[p] if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [(1, "http://a/\r\nX: y", "x" * 200), (3, None, "x" * 200), (2, "u", "x" * 200),
       (None, "u", "x" * 200), (4, "", None), (5, "u", ""), (6, "u", "y" * 99), (7, "u", "y" * 99),
       (8, "u", "é漢😀\r\n" * 300), (9, "u", "WARC/1.0\r\nWARC-Type: response\r\n\r\nx"),
       (10, "u", "\n" * 500), (11, "u", "\r\n\r\n" * 100 + "\r"), (12, "u", "ends with a break\n" * 20),
       (2, "u", "x" * 200), (13, "u", "0\r\n\r\n" * 80), (14, "u", "z" * 300_000 + "\n" + "z" * 70_000)]


@pytest.mark.parametrize("chunk_bytes", [7, 64, 100, 1 << 16])
def test_round_trip(spark, chunk_bytes):
    odd = ODD if chunk_bytes > 50 else ODD[:-1]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string").repartition(3)
    assert found(warc.round_trip(clashing(pages), chunk_bytes)) == expected(odd)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    copies = spark.createDataFrame([(10_000 + i, u, h) for i, u, h in rows[:20]], pages.schema)
    assert found(warc.round_trip(pages.unionByName(copies), 1000)) == expected(
        rows + [(10_000 + i, u, h) for i, u, h in rows[:20]])


def parsed(path):
    """A parser by the standard alone: (fields, block) of all records."""
    out = []
    for name in sorted(os.listdir(path)):
        data = gzip.open(f"{path}/{name}").read() if name.endswith(".gz") else b""
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            version, *lines = head.decode().split("\r\n")
            assert version == "WARC/1.1"
            fields = [x.split(": ", 1) for x in lines]
            assert len(dict(fields)) == len(fields)
            size = int(dict(fields)["Content-Length"])
            assert data[size:size + 4] == b"\r\n\r\n"
            out.append((dict(fields), data[:size]))
            data = data[size + 4:]
    return out


def payload(block):
    head, body = block.split(b"\r\n\r\n", 1)
    if b"chunked" not in head:
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body)
        return body
    out = b""
    while True:
        size, body = body.split(b"\r\n", 1)
        n = int(size, 16)
        if not n:
            assert body == b"\r\n"
            return out
        assert body[n:n + 2] == b"\r\n"
        out, body = out + body[:n], body[n + 2:]


def test_archives_are_warc(spark, tmp_path):
    """Mandatory fields, identifiers of their own, payloads that have their
    digest, revisits that name the address and date of their response."""
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/w"
    warc.write(warc.records(pages), path, 64)
    recs = parsed(path)
    assert len(recs) == len(ODD) == len({f["WARC-Record-ID"] for f, _ in recs})
    responses = {}
    for f, block in recs:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", f["WARC-Record-ID"])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"])
        assert f["WARC-Target-URI"] and not re.search(r"\s", f["WARC-Target-URI"])
        if f["WARC-Type"] == "response":
            assert f["Content-Type"].startswith("application/http")
            digest = "sha256:" + hashlib.sha256(payload(block)).hexdigest()
            assert digest == f["WARC-Payload-Digest"]
            responses.setdefault(digest, set()).add((f["WARC-Target-URI"], f["WARC-Date"]))
    revisits = [f for f, _ in recs if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 4
    for f in revisits:
        assert (f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"]) \
            in responses[f["WARC-Payload-Digest"]]


def test_a_revisit_needs_its_response(spark):
    pages = spark.createDataFrame(ODD[:3], "page_id long, url string, html string")
    recs = warc.records(pages).drop("payload", "url", "refers_to_url")
    assert warc.resolved(recs).count() == 3
    with pytest.raises(Exception, match="no response for the revisit of page"):
        warc.resolved(recs.filter("page_id <> 1")).collect()


def test_rows_are_no_larger_than_a_chunk(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 50_000)], "page_id long, url string, html string")
    rows = warc.chunk_rows(warc.records(pages), 1000).collect()
    assert [r["chunk_no"] for r in rows] == list(range(102))
    assert max(len(r["data"]) for r in rows) <= 1012


def test_damage_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 300)], "page_id long, url string, html string")
    recs = warc.records(pages).withColumn("payload_digest", F.lit("0" * 64))
    warc.write(recs, f"{tmp_path}/w")
    with pytest.raises(Exception, match="payload and digest differ"):
        warc.read(spark, f"{tmp_path}/w").collect()


def test_empty_table(spark):
    assert found(warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))) == []
