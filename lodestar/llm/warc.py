"""WARC records in a content-addressed archive.

An archive is two Parquet tables: `payloads` holds each distinct payload once, under its SHA-256, and
`records` holds the exact bytes of every record's headers, the key of its payload and whether the record
carries it. Original records are rebuilt by joining the two.

Payloads are pre-aggregated by (digest, payload) before the one shuffle that carries them, so copies leave
a task as one row and equal digests have their bytes compared; two payloads under one digest stop the
write before any record is written, with an error that names the digest. Which record is the response is an aggregate over thin rows, joined back on the digest, a join that
adaptive execution splits on a hot payload.

Defined results. A null payload counts as empty; a null url gives the target URI "urn:unknown". A null id
is never a response unless all ids of its payload are null; it then is one. Rows that repeat both id and
payload are one record each, of the same type. An empty table gives empty archives. Extra columns are not
stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The payload's SHA-1 as 32 bare upper-case base32 characters: each 5 hexadecimal digits give 4 of them."""
    hexed, out = F.sha1(payload), []
    for k in range(8):
        n = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def sha256(payload: Column) -> Column:
    return F.sha2(payload, 256)


def write_archive(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedup_from_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", strong_digest: Callable[[Column], Column] = sha256
) -> None:
    """Writes `payloads` and `records` under `path`, a folder that all executors share.

    Of records with equal payloads of at least `dedup_from_bytes` bytes, the one with the largest id is the
    response and the others revisit it; smaller payloads make every record a response.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("urn:unknown")).alias("url"), payload.alias("payload"), strong_digest(payload).alias("payload_key"))
    stored = base.groupBy("payload_key", "payload").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("uses"))
    stored.select("payload_key", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "holder", "uses").write.option("compression", "zstd").parquet(f"{path}/payloads")
    held = pages.sparkSession.read.parquet(f"{path}/payloads").select("payload_key", "payload_bytes", "payload_digest", "holder")
    if twice := held.groupBy("payload_key").count().where("count > 1").head():
        raise ValueError(f"two payloads have the digest {twice.payload_key}")
    thin = base.select("page_id", "url", "payload_key").join(held, "payload_key")
    revisit = (F.col("payload_bytes") >= dedup_from_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    thin = thin.withColumn("revisit", revisit)
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    uuid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    length = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uuid(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", uuid(F.col("holder"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    thin.select("page_id", "payload_key", header.cast("binary").alias("header"), http.cast("binary").alias("http_header"), (~F.col("revisit")).alias("carries_payload")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads: payload_key, payload, and what is computed anew from the bytes read: payload_bytes, payload_digest, verified."""
    read = spark.read.parquet(f"{path}/payloads").select("payload_key", "payload")
    return read.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), (F.sha2("payload", 256) == F.col("payload_key")).alias("verified"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every original record, byte for byte: page_id, record (headers, HTTP headers, payload where it carries one, two line ends)."""
    payloads = spark.read.parquet(f"{path}/payloads").select("payload_key", "payload")
    joined = spark.read.parquet(f"{path}/records").join(payloads, "payload_key")
    body = F.when(F.col("carries_payload"), F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", F.concat("header", "http_header", body, F.lit((CRLF * 2).encode())).alias("record"))


def header_field(header: Column, name: str) -> Column:
    """A named field of a record's header block, null where it has none."""
    return F.nullif(F.regexp_extract(header.cast("string"), rf"\n{name}: ([^\r\n]*)", 1), F.lit(""))


def parse_records(records: DataFrame) -> DataFrame:
    """Whole records (page_id, record) taken apart: record_type, target_uri, refers_to, digest, content_length, block (HTTP headers and payload)."""
    text = F.decode("record", "iso-8859-1")
    cut = F.locate(CRLF * 2, text)
    header = F.substr(text, F.lit(1), cut + 1)
    length = header_field(header, "Content-Length").cast("int")
    return records.select(
        "page_id",
        header_field(header, "WARC-Type").alias("record_type"),
        header_field(header, "WARC-Target-URI").alias("target_uri"),
        header_field(header, "WARC-Refers-To").alias("refers_to"),
        header_field(header, "WARC-Payload-Digest").alias("digest"),
        length.alias("content_length"),
        F.substr(F.col("record"), cut + 4, length).alias("block"),
    )


def archive_digest(pages: DataFrame, *, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedup_from_bytes: int = 0) -> DataFrame:
    """Writes the archive, reads it back, and gives one row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archive(pages, path, id_col=id_col, url_col=url_col, payload_col=payload_col, dedup_from_bytes=dedup_from_bytes)
    records = spark.read.parquet(f"{path}/records").select("page_id", "payload_key", "header")
    found = records.join(read_payloads(spark, path).drop("payload"), "payload_key")
    refers = F.regexp_extract(F.coalesce(header_field(F.col("header"), "WARC-Refers-To"), F.lit("")), r"^<urn:page:(.*)>$", 1)
    return found.select("page_id", "payload_bytes", "payload_digest", header_field(F.col("header"), "WARC-Type").alias("record_type"), F.nullif(refers, F.lit("")).cast(pages.schema[id_col].dataType).alias("refers_to"), "verified")


ORACLE = f"""
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to, true AS verified
FROM (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder FROM pages)
"""
