"""WARC archives with revisit resolution.

Headers (page, payload digest, size) are shuffled by digest; of equal payloads of at least ``min_bytes``
the page with the smallest id keeps its response record, and the others become ``revisit`` records that
refer to it and carry no payload. Only digests that occur more than once meet the pages again. The archives
are written with fresh headers, and every result is read back from them.

Files are gzip-compressed text-sink output of at most RECORDS_PER_FILE records. A record is its header block,
an HTTP response head and the payload; ``Content-Length`` delimits it, so payloads may hold any bytes. The
record separator ``\\r\\n\\r\\n`` is the sink's line separator. Header values never hold line ends: the target
URI is percent-encoded where it has control characters or spaces.

Defined cases: null html is an empty payload; null page ids are written, never chosen as an original while a
page with an id has the payload, and read back as null; a null url gives an empty target; rows that repeat a
page id are records of their own, and only one with the smallest id is the response; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.session import checkpoint_dir, materialize

RECORDS_PER_FILE = 2000
#: Digests of repeated payloads that may be broadcast (about 60 bytes each); beyond it Spark shuffles the pages.
MAX_BROADCAST_DIGESTS = 500_000
MIN_BYTES = 0
EOL = "\r\n"

# Fixed value: the profile that the WARC standard names for identical payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four runs of 40 bits, each 8 digits of 5 bits."""
    h = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*runs), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit("page"), page_id.cast("string"), copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def headers(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes and payload_digest."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
            .withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", payload_digest(F.encode("html", "UTF-8"))))


def originals(head: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(payload_digest, original): for each payload that occurs more than once, the smallest page id that has it.

    Counts and the minimum are combined before the shuffle, so a payload that a third of the pages share is
    one row per task."""
    return (head.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("original"))
            .where("n > 1").select("payload_digest", "original"))


def resolve_revisits(head: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``head`` with record_type and refers_to."""
    first = originals(head.select("page_id", "payload_bytes", "payload_digest"), min_bytes)
    first = materialize(first, "warc-originals")
    few = first.count() <= MAX_BROADCAST_DIGESTS
    both = head.join(F.broadcast(first) if few else first.hint("merge"), "payload_digest", "left")
    return both.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))).drop("original") \
               .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _lines(*parts: Column) -> Column:
    """Header lines; a null line is left out."""
    return F.concat_ws(EOL, *parts)


def records(resolved: DataFrame) -> DataFrame:
    """One column ``record``: each row as the text of a WARC record, without the separator after it."""
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    own = F.lit(0)
    head = _lines(F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
                  F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), own)),
                  F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), target),
                  F.lit("Content-Type: application/http; msgtype=response"),
                  F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
                  F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), own))),
                  F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
                  F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
                  F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
                  F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))))
    length = F.octet_length(block).cast("string")
    return resolved.select(F.concat(head, F.lit(f"{EOL}Content-Length: "), length, F.lit(EOL + EOL), block).alias("record"))


def write_archives(resolved: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives under ``path``, one record after another, by Spark's commit protocol."""
    (records(resolved).write.mode("overwrite").option("lineSep", EOL + EOL).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse(stream) -> "iter":
    """(headers, payload) of each record of an uncompressed archive; ValueError if it is cut short."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield head, block.partition(b"\r\n\r\n")[2]


def _read(batches):
    cols = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    schema = pa.schema(list(zip(cols, kinds, strict=True)))
    number = lambda x: int(x) if x else None
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for head, payload in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                if kind == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                    raise ValueError(f"the payload of page {head.get('x-page-id')} doesn't match its digest")
                rows.append((number(head.get("x-page-id")), head["warc-target-uri"], int(head["x-payload-length"]), digest, kind,
                             number(head.get("x-refers-to-page-id")), payload if kind == "response" else None))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)


def _read_headers(batches):
    for batch in _read(batches):
        yield batch.drop_columns(["payload"])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under ``path``; payloads of responses are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.mapInArrow(_read, schema + ", payload binary") if payloads else files.mapInArrow(_read_headers, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
    write_archives(resolve_revisits(headers(spark.read.parquet(f"{sf_dir}/pages.parquet"))), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT) >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest FROM h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""
