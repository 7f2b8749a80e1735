"""WARC archives through a chunked record table.

A record is a run of rows (record id, chunk number, bytes), each of which ends
with a line end, so Spark's own text writer and reader move it on any file
system.  A payload over ``chunk_bytes`` is written in the chunked transfer
coding of HTTP (size in hex, that many bytes), so no row or line is larger
than a chunk.  Archives are gzip files, which Spark does not split: the reader sees
each file's lines in order, and a small state machine carries the digest and
the count of the current payload from line to line.  Neither side ever joins
a payload's chunks.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import materialize

REVISIT_FROM = 100          # bytes; smaller equal payloads stay responses
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """Pages as records: page_id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to, refers_to_url.

    Equal payloads of at least 100 bytes: the smallest page_id (nulls last) is
    the response, the others revisit it; rows that repeat that page_id are
    responses as well.  Only digests and ids are shuffled to find them.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    p = pages.select(F.col(page_id).cast("long").alias("page_id"),
                     F.col(url).cast("string").alias("url"), payload.alias("payload"))
    p = (p.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
         .withColumn("payload_digest", F.sha2("payload", 256)))
    big = F.col("payload_bytes") >= REVISIT_FROM
    first = (p.filter(big).groupBy(F.col("payload_digest").alias("d"))
             .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
                  .alias("f"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and f is not null")
             .select("d", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")))
    p = p.join(first, big & (F.col("payload_digest") == F.col("d")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)) for name, value in pairs])


def _uri(url: str, page: str) -> Column:
    """An address without blanks; a page without one is named by its id."""
    given = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20\\x7f]", "%20")
    return F.when(given != "", given).otherwise(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit(""))))


def _header(date: str) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    size, n = F.col("payload_bytes"), F.col("n")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF),
        F.when(F.col("chunked"), F.lit("Transfer-Encoding: chunked" + _CRLF))
        .otherwise(_fields(("Content-Length", text(size)))), F.lit(_CRLF))
    # framing of a chunk: eight hex digits and two line ends; of the last: five bytes
    body = size + F.when(F.col("chunked"), n * 12 + 5).otherwise(0)
    common = F.concat(F.lit(_VERSION + _CRLF), _fields(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("uuid"), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _uri("url", "page_id")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ("X-Page-ID", text(F.col("page_id")))))
    response = F.concat(_fields(
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", text(F.octet_length(http) + body))), F.lit(_CRLF), http)
    revisit = F.concat(_fields(
        ("WARC-Profile", F.lit(_PROFILE)),
        ("WARC-Refers-To-Target-URI", _uri("refers_to_url", "refers_to")),
        ("WARC-Refers-To-Date", F.lit(date)), ("X-Refers-To-Page-ID", text(F.col("refers_to"))),
        ("Content-Length", F.lit("0"))), F.lit(_CRLF))
    return F.concat(common, F.when(F.col("record_type") == "revisit", revisit)
                    .otherwise(response)).cast("binary")


def chunk_rows(recs: DataFrame, chunk_bytes: int,
               date: dt.datetime | None = None) -> DataFrame:
    """The chunked record table: record_id, chunk_no, data.

    ``date`` (UTC; default: now) is the date of every record; each has a
    random identifier of its own, also where pages repeat.

    Chunk 0 is the header.  A small payload follows as one row with the two
    line ends that close the record; a larger one as rows of ``chunk_bytes``
    each in chunked coding, and a closing row.  The rows of a record stay
    together and in order, in the partition of the record, and every row ends
    with a line end.
    """
    response = F.col("record_type") == "response"
    chunked = response & (F.col("payload_bytes") > chunk_bytes)
    n = F.when(chunked, F.expr(f"(payload_bytes + {chunk_bytes - 1}) div {chunk_bytes}")) \
        .otherwise(0)
    when = (date or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = (recs.withColumn("chunked", chunked).withColumn("n", n.cast("int"))
            .withColumn("uuid", F.uuid())
            .select("*", F.explode(F.sequence(F.lit(0), F.col("n") + 1)).alias("chunk_no")))
    no = F.col("chunk_no")
    piece = F.substring(F.col("payload"), (no - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
    raw = lambda s: F.lit(s).cast("binary")
    framed = F.concat(F.format_string("%08x", F.octet_length(piece)).cast("binary"), raw(_CRLF),
                      piece, raw(_CRLF))
    end = (F.when(F.col("chunked"), raw("0" + _CRLF * 4))
           .when(response, F.concat(F.col("payload"), raw(_CRLF * 2)))
           .otherwise(raw(_CRLF * 2)))
    data = F.when(no == 0, _header(when)).when(no <= F.col("n"), framed).otherwise(end)
    return rows.select(F.col("page_id").alias("record_id"), "chunk_no", data.alias("data"))


def write(recs: DataFrame, path: str, chunk_bytes: int = 1 << 16) -> None:
    """Write records as gzip archives under ``path``, one per partition.

    The writer ends each row with a line feed, the last byte of every chunk
    row, so the files hold exactly the records' bytes.
    """
    data = F.col("data")
    chunk_rows(recs, chunk_bytes) \
        .select(F.substring(data, F.lit(1), F.octet_length(data) - 1).cast("string").alias("value")) \
        .write.option("compression", "gzip").text(path)


class _Reader:
    """State of one archive while its lines go by (without their line feeds)."""

    def __init__(self):
        self.state, self.head, self.http = "start", {}, {}

    def feed(self, line: bytes) -> tuple | None:
        """Take one line; return a record when one ends."""
        if self.state == "body":
            line = line + b"\n"
            part, rest = line[:self.left], line[self.left:]
            self.digest.update(part)
            self.size += len(part)
            self.left -= len(part)
            if self.left:
                return None
            if self.chunked:
                self.state = "size" if rest else "chunk_end"
            else:
                self.state, self.ends = "close", 1 if rest else 2
            return None
        if self.state == "start":
            if line.startswith(b"WARC/"):
                self.state, self.head, self.http = "head", {}, {}
        elif self.state in ("head", "http"):
            if line != b"\r":
                name, _, value = line.rstrip(b"\r").partition(b": ")
                (self.head if self.state == "head" else self.http)[name.lower()] = value.decode()
                return None
            self.digest, self.size, self.ends = hashlib.sha256(), 0, 2
            if self.state == "head":
                self.state = "http" if int(self.head[b"content-length"]) else "close"
                return None
            self.chunked = self.http.get(b"transfer-encoding") == "chunked"
            self.left = 0 if self.chunked else int(self.http[b"content-length"])
            self.state = "size" if self.chunked else "body" if self.left else "close"
        elif self.state == "size":
            self.left = int(line, 16)
            self.state, self.ends = ("body", 2) if self.left else ("close", 3)
        elif self.state == "chunk_end":
            self.state = "size"
        else:
            self.ends -= 1
            if not self.ends:
                self.state = "start"
                return self._record()
        return None

    def _record(self) -> tuple:
        page = lambda name: int(v) if (v := self.head.get(name)) else None
        kind = self.head[b"warc-type"]
        told = self.head[b"warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and self.digest.hexdigest() != told:
            raise ValueError(f"record {self.head[b'warc-record-id']}: payload and digest differ")
        return (page(b"x-page-id"), self.size if kind == "response" else None, told, kind,
                page(b"x-refers-to-page-id"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read archives back: page_id, payload_bytes, payload_digest, record_type,
    refers_to.  Digest and length of every response are computed from the
    bytes read; a digest that is not the header's is an error.  A revisit has
    no length of its own (see :func:`resolved`)."""
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long")

    def run(batches):
        name, reader = None, _Reader()
        for batch in batches:
            out = []
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != name:
                    name, reader = file, _Reader()
                rec = reader.feed(line)
                if rec:
                    out.append(rec)
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, kinds)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"),
                        F.col("value").cast("binary").alias("line")).mapInArrow(run, schema)


def resolved(recs: DataFrame) -> DataFrame:
    """Records read, each revisit with the length of the response it refers
    to; a revisit whose response is missing, or has another payload, is an
    error.  Only ids, digests and lengths are shuffled."""
    told = (recs.filter("record_type = 'response'")
            .groupBy(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"))
            .agg(F.max("payload_bytes").alias("b")))
    none = F.raise_error(F.concat(F.lit("no response for the revisit of page "),
                                  F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    revisits = (recs.filter("record_type = 'revisit'")
                .join(told, (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d")),
                      "left")
                .withColumn("payload_bytes", F.coalesce("b", none.cast("long")))
                .select(*recs.columns))
    return recs.filter("record_type <> 'revisit'").unionByName(revisits)


def round_trip(pages: DataFrame, chunk_bytes: int = 1 << 16, path: str | None = None,
               page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per page, then read the archives back.

    A null payload counts as empty; null ids and addresses are written as
    empty fields and come back null; repeated pages give repeated records; an
    empty table gives no record; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex}"
    write(records(pages, page_id, url, html), path, chunk_bytes)
    return resolved(materialize(read(spark, path), "warc_records"))
