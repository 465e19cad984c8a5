"""Web archives: write captures as WARC records, read and assemble them.

Every capture is a request, a response or revisit, and a metadata record; the
first and the last name the second by WARC-Concurrent-To.  Payloads that occur
again are written once, and later captures revisit the first one.  Files are
written by Spark's text writer, whose line separator is the two line ends that
close a record.  Reading parses records by their declared lengths, so payloads
may hold anything; assembling joins them into one nested row per capture.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.scratch import materialize

REVISIT_BYTES = 100
FILE_BYTES = 16 << 20
_END = "\r\n"


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends that close it."""
    lines = [F.lit(f"WARC/1.1{_END}WARC-Type: {kind}{_END}")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit(_END + _END), block)


def _urn(kind: str) -> Column:
    """A record id that is fixed by page, url and payload."""
    name = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest",
                             F.coalesce("url", F.lit("-"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
               date: str = "2020-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write three records per page below ``path``.

    Of pages with equal payloads of ``REVISIT_BYTES`` or more, those with the
    smallest page_id are responses and the rest revisits; null ids come last.  A
    null html is an empty payload; control characters and spaces of a url are
    percent-encoded in headers, and a null url has none; repeated rows give
    repeated records.  Files hold about ``file_bytes``.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("bytes", F.octet_length("html"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.coalesce("url", F.lit("")).alias("of"), "url"))
    heads = rows.select("page_id", "url", "digest", "bytes")
    firsts = (
        heads.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(first.alias("first"), F.count("*").alias("number"))
        .where("number > 1").select("digest", F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"))
    )
    target = materialize(firsts.select(F.col("digest").alias("of"), F.col("page_id").alias("first_id"),
                                       _urn("capture").alias("refers_to")), "firsts")
    sized = rows.join(target, F.col("digest") == F.col("of"), "left")
    again = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), " ", "%20"), r"[\x00-\x1F\x7F]", "%0A")
    own = _urn("capture")
    shared = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(_END + _END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    request = _record("request", [("WARC-Record-ID", _urn("request")), ("WARC-Concurrent-To", own), *shared,
                                  ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{_END}{_END}")))
    response = _record("response", [("WARC-Record-ID", own), *shared, digest, http], F.concat(head, F.col("html")))
    revisit = _record("revisit", [
        ("WARC-Record-ID", own), *shared, digest, ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), http], head)
    metadata = _record("metadata", [("WARC-Record-ID", _urn("metadata")), ("WARC-Concurrent-To", own), *shared,
                                    ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_END)))
    records = sized.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))
    mean = heads.agg(F.avg("bytes")).first()[0] or 0
    (records.write.option("lineSep", _END + _END)
     .option("maxRecordsPerFile", max(3, int(file_bytes // (mean / 3 + 800)))).text(path))


def records_of(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers (lower-case names) and block of each record of a file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in lines:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode()
        begin = end + 4
        size = int(headers["content-length"])
        yield at, headers, data[begin:begin + size]
        at = begin + size + 4


def _split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in fields}, body


_NAMES = {"record_id": "warc-record-id", "concurrent_to": "warc-concurrent-to", "refers_to": "warc-refers-to",
          "target_uri": "warc-target-uri", "date": "warc-date"}
_RECORD = ("file string, offset long, record_type string, record_id string, concurrent_to string, refers_to string, "
           "target_uri string, date string, payload_bytes long, payload_digest string, fields string, payload binary")


def _parse(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, headers, block in records_of(content.as_py()):
                    kind, size, digest, fields, payload = headers["warc-type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        http, payload = _split_http(block)
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if kind == "revisit":
                            size = int(http["content-length"])
                            digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    elif kind == "metadata":
                        fields = block.decode()
                    rows.append((file, offset, kind, *(headers.get(n) for n in _NAMES.values()), size, digest, fields,
                                 payload if keep_payload else None))
                if rows:
                    kinds = (pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.binary())
                    names = ["file", "offset", "record_type", *_NAMES, "payload_bytes", "payload_digest", "fields", "payload"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of all archives below ``path``, one row each, with their place.

    Lengths and digests of responses are those of the payload read; a revisit has
    those it declares.  A task holds one file at a time.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse(keep_payload), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), request and metadata.

    A response or revisit is a capture; requests and metadata join it by the
    identifier they are concurrent to, of several the one with the smallest
    record id.  A capture without them has nulls there; a record that is
    concurrent to nothing known is left out.
    """
    def partner(kind: str) -> DataFrame:
        return records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(
            F.col("concurrent_to").alias("record_id")).agg(
            F.min(F.struct(F.col("record_id").alias("id"), "target_uri", "date", "fields", "file", "offset")).alias(kind))

    captures = records.where(F.col("record_type").isin("response", "revisit"))
    return captures.select("record_id", F.struct(*captures.columns).alias("response")).join(
        partner("request"), "record_id", "left").join(partner("metadata"), "record_id", "left")


def with_origin(captures: DataFrame) -> DataFrame:
    """Captures with page_id (from their metadata) and refers_to (the page_id a revisit refers to)."""
    named = captures.withColumn(
        "page_id", F.regexp_extract(F.col("metadata.fields"), r"(?m)^page-id: (-?\d+)", 1).try_cast("long"))
    known = materialize(named.where("response.record_type = 'response'").groupBy(F.col("record_id").alias("of")).agg(
        F.min("page_id").alias("refers_to")), "responses")
    return named.join(known, F.col("response.refers_to") == F.col("of"), "left").drop("of")
