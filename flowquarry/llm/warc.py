"""Operator 9: WARC archives with revisit resolution.

Every row of pages becomes one record. Headers (id, payload digest) are shuffled by digest; the smallest page of a
digest becomes the response and the others are joined to it as revisits. Archives are written by Spark's gzip text writer, whose line separator is the
end of a WARC record, into any file system Spark reaches; they are read back as
streams of records, a few megabytes at a time.

Defined cases: a null payload is empty; payloads below ``least_bytes`` are always responses; rows that
share a page_id are resolved each by its own payload, and rows that share that too are revisits of the first (by url);
a page with a null page_id is always a response; a null url leaves the header out, line breaks
in it become blanks; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path

CRLF = "\r\n"
END = b"\r\n\r\n"


@dataclass(frozen=True)
class WarcConfig:
    least_bytes: int = 100
    records_per_file: int = 10_000
    date: str = "2024-01-01T00:00:00Z"


def resolve(pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """(page_id, html, url, digest, bytes, key, copy, response_id) of every row; response_id is null unless it is a revisit."""
    html = F.coalesce("html", F.lit(""))
    digest, size = F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    # Rows without an id are always responses; the number of their input partition keeps them from one key.
    key = F.coalesce(name, F.concat(F.lit("n"), F.spark_partition_id().cast("string")))
    heads = pages.where(F.col("page_id").isNotNull()).select("page_id", digest, size).where(F.col("bytes") >= cfg.least_bytes).select("page_id", "digest").distinct()
    first = heads.groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count("*").alias("ids")).where("ids > 1")
    # Only pages that are not their digest's response are joined back, by key and digest.
    moved = heads.join(first, "digest").where("page_id <> response_id").select(name.alias("moved_key"), F.col("digest").alias("moved_digest"), "response_id")
    full = pages.select("page_id", html.alias("html"), "url", digest, size, key.alias("key"))
    full = full.withColumn("copy", F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")))
    # The pages are dealt by key and digest already, so this join moves no payload again.
    out = full.join(moved, (full.key == moved.moved_key) & (full.digest == moved.moved_digest), "left").drop("moved_key", "moved_digest")
    again = (F.col("copy") > 1) & F.col("page_id").isNotNull() & (F.col("bytes") >= cfg.least_bytes)
    return out.withColumn("response_id", F.coalesce("response_id", F.when(again, F.col("page_id"))))


def _uuid(key, copy) -> F.Column:
    """The record id of a row: of its key, its payload's digest and its number among the rows that share both."""
    h = F.md5(F.concat_ws("|", key, F.col("digest"), copy.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(resolved: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """One string for each record, without the blank lines that end it."""
    revisit = F.col("response_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("bytes"))
    url = F.regexp_replace("url", "[\r\n]+", " ")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _uuid(F.col("key"), F.col("copy"))),
        F.lit(f"WARC-Date: {cfg.date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uuid(F.concat(F.lit("p"), F.col("response_id").cast("string")), F.lit(1)))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return resolved.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write(resolved: DataFrame, path: str, cfg: WarcConfig = WarcConfig()) -> str:
    records(resolved, cfg).write.option("lineSep", END.decode()).option("maxRecordsPerFile", cfg.records_per_file).option("compression", "gzip").text(path)
    return path


def parse(f: io.BufferedIOBase):
    """(headers, block) of each record of an archive, read as a stream: one record is in memory at a time."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record but {line[:40]!r}")
        headers = {}
        while (line := f.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("an archive ends within a header")
            name, value = line[:-2].decode("utf-8").split(": ", 1)
            headers[name] = value
        block = f.read(int(headers["Content-Length"]))
        if f.read(4) != END:
            raise ValueError(f"record {headers.get('WARC-Record-ID')} does not end where it should")
        yield headers, block


def read(spark, path: str, page_kind: str = "bigint") -> DataFrame:
    """(page_id, record_type, record_id, refers_uuid, payload_digest, payload_bytes, payload) of archives; the digest of each payload is checked."""

    names = ["page_id", "record_type", "record_id", "refers_uuid", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def rows(data: pa.Scalar):
        # Archives are compressed; what they hold passes by in pieces.
        for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(data.as_buffer())), 1 << 20)):
            digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
            if h["WARC-Type"] == "revisit":
                yield h.get("X-Page-ID"), "revisit", h["WARC-Record-ID"], h["WARC-Refers-To"], digest, None, None
                continue
            payload = block[block.index(END) + 4 :]
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload digest differs in {h['WARC-Record-ID']}")
            yield h.get("X-Page-ID"), "response", h["WARC-Record-ID"], None, digest, len(payload), payload

    def part(batches):
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for b in batches:
            for data in b.column(0):
                held, size = [], 0
                for row in rows(data):
                    held.append(row)
                    size += row[5] or 0
                    if len(held) == 1000 or size > 8_000_000:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(part, "page_id string, record_type string, record_id string, refers_uuid string, payload_digest string, payload_bytes long, payload binary")
    return out.withColumn("page_id", F.col("page_id").cast(page_kind))


def resolved_pages(archive: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Join revisits to their responses: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    light = archive.drop("payload")
    responses = light.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes)).select("payload_digest", F.col("record_id").alias("refers_uuid"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    revisits = light.where("record_type = 'revisit'").join(responses, ["payload_digest", "refers_uuid"], "left")
    return light.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(dict(light.dtypes)["page_id"]).alias("refers_to")).unionByName(revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def roundtrip(pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """op9: write the archives, read them back."""
    spark = pages.sparkSession
    path = write(resolve(pages, cfg), fresh_path(spark, "warc"), cfg)
    return resolved_pages(read(spark, path, dict(pages.dtypes)["page_id"]), cfg.least_bytes)
