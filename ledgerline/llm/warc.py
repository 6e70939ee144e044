"""A content-addressed WARC archive.

``write_archive`` keeps two tables: payload bytes once per SHA-256 digest
(zstd-compressed), and the exact header block of every record. ``read_archive``
joins them back to the original records: it unpacks each stored payload,
recomputes its SHA-256 and SHA-1 and raises if either differs from the header,
so a wrong or swapped payload can't pass. ``record_bytes`` gives the bytes of
the WARC/1.1 records.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the largest page_id is a ``response``; the others are ``revisit`` records that
refer to it and have no payload block. Records of smaller payloads are all
responses (their bytes are still stored once).

Defined results: null html is an empty payload; rows tied at the largest
page_id are all responses; a null page_id loses to any other; a null url gives
an empty target; line breaks in a url are percent-encoded; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ledgerline.llm.common import shipped, stored

MIN_REVISIT = 1000
CRLF = "\r\n"
HTTP_HEADER = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    headers: DataFrame  # page_id, digest, header
    payloads: DataFrame  # digest, packed


@F.pandas_udf(BinaryType())
def pack(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    z = zstandard.ZstdCompressor(level=3)
    for s in payloads:
        yield s.map(z.compress)


@F.pandas_udf(BinaryType())
def unpack(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
    z = zstandard.ZstdDecompressor()
    for s in packed:
        yield s.map(lambda b: z.decompress(b) if b is not None else None)


def _line(name: str, value):
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def record_header(date: str):
    """The header block of a record from page_id, url, sha1, sha256, n_bytes and refers_to."""
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))  # noqa: E731,E501
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    block = F.lit(len(HTTP_HEADER)) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", urn("page_id")),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(date)),
        F.when(revisit, F.concat(_line("WARC-Refers-To", urn("refers_to")),
                                 _line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("X-Payload-Length", F.col("n_bytes").cast("string")),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF))


def write_archive(pages: DataFrame, min_revisit: int = MIN_REVISIT,
                  date: str = "1970-01-01T00:00:00Z") -> Archive:
    shipped(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    payloads = stored(rows.select("digest", pack("payload").alias("packed"))
                      .dropDuplicates(["digest"]), "payloads")
    facts = stored(rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"),
                               F.octet_length("payload").cast("long").alias("n_bytes")), "facts")
    responses = facts.where(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(
        F.max("page_id").alias("_response"))
    facts = facts.join(responses, "digest", "left")
    revisit = (F.col("n_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("_response"))
    facts = facts.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"),
                               "refers_to": F.when(revisit, F.col("_response"))})
    headers = stored(facts.select("page_id", "digest", record_header(date).alias("header")),
                     "headers")
    return Archive(headers, payloads)


def field(name: str):
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)


def read_archive(archive: Archive) -> DataFrame:
    """Original records: page_id, header, record_type, refers_to, payload, digests and length.

    Payload rows are joined by digest; a record whose payload is missing,
    has another digest or another length stops the job.
    """
    rows = archive.headers.join(archive.payloads, "digest", "left").withColumn(
        "payload", unpack("packed"))
    rows = rows.withColumns({
        "record_type": field("WARC-Type"),
        "refers_to": F.expr("try_cast(regexp_extract(header, "
                            "'WARC-Refers-To: <urn:x-page:([^>]*)>', 1) as bigint)"),
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": F.sha1("payload")})
    whole = ((F.sha2("payload", 256) == F.col("digest"))
             & (F.concat(F.lit("sha1:"), "payload_digest") == field("WARC-Payload-Digest"))
             & (F.col("payload_bytes").cast("string") == field("X-Payload-Length")))
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("stored payload doesn't match its record: "), "digest"))
        .cast("string"))
    return rows.withColumn("payload_digest", checked).drop("packed")


def record_bytes(records: DataFrame) -> DataFrame:
    """(page_id, record): the bytes of each WARC record, as an archive file holds them."""
    payload = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(
        F.col("payload"))
    return records.select("page_id", F.concat(
        F.col("header").cast("binary"), F.lit(HTTP_HEADER).cast("binary"), payload,
        F.lit(CRLF * 2).cast("binary")).alias("record"))
