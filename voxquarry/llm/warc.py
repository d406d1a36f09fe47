"""Content-addressed WARC archive.

An archive is a folder with two tables.  ``payloads`` holds the bytes of each
distinct payload once, under its SHA-256 digest; ``headers`` holds one row per
record with the exact WARC and HTTP header bytes and the digest of its
payload.  Records are rebuilt by a join on the digest.  Of records with equal
payloads of at least ``min_bytes`` the one with the smallest page id is a
response, the others are revisits that refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

EPOCH = "2000-01-01T00:00:00Z"  # pages carry no time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(
    pages: DataFrame,
    out: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 100,
) -> str:
    """Write one record per page; returns the archive folder (``out``, or a fresh one in the shared folder).

    Only ids, digests and sizes are grouped; a digest that a third of all
    pages share is pre-aggregated per task.  Payload bytes move once, to meet
    the list of pages whose bytes are stored.

    Null html is an empty payload, null urls an empty target.  Pages with a
    null id are responses.  Rows that repeat a page id are records of their
    own, all of the type of that id; equal bytes are stored once all the same.
    Line breaks in urls become spaces.  Other columns are ignored.  No rows: an empty
    archive.
    """
    spark = pages.sparkSession
    out = out or scratch_path(spark, "warc")
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]+", " ").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )
    facts = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"))
    first = facts.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    # the digest's own row keeps its bytes: the page with the smallest id, or one of those without an id;
    # the join's partitioning serves dropDuplicates too, so payloads are shuffled once
    pid = F.coalesce("page_id", F.lit(-(2**63)))
    keep = first.select(F.coalesce("first_id", F.lit(-(2**63))).alias("pid"), "digest")
    stored = (
        rows.select(pid.alias("pid"), F.sha2("payload", 256).alias("digest"), "payload")
        .join(keep, ["pid", "digest"], "left_semi")
        .dropDuplicates(["pid", "digest"])
        .select("digest", "payload")
    )
    stored.write.option("compression", "zstd").parquet(f"{out}/payloads")
    typed = facts.join(first.select("digest", "first_id"), "digest").withColumn(
        "revisit", F.coalesce((F.col("bytes") >= min_bytes) & (F.col("page_id") != F.col("first_id")), F.lit(False))
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")
    )
    body = F.when(F.col("revisit"), F.octet_length(http)).otherwise(F.octet_length(http) + F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_uri(F.col("page_id"))),
        _line("WARC-Date", F.lit(EPOCH)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(_line("WARC-Refers-To", record_uri(F.col("first_id"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", body.cast("string")),
        F.lit("\r\n"),
        http,
    )
    typed.select("digest", head.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{out}/headers")
    return out


def field(name: str) -> Column:
    """A WARC header field of a record; null if absent."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive, each rebuilt from its header and the stored payload.

    Returns ``page_id, record_type, refers_to, url, payload_bytes,
    payload_digest, verified, payload, record``.  Digest and size are taken
    from the stored bytes; ``verified`` says whether the digest is the one the
    header names.  ``record`` is the exact record: header, payload of a
    response, and the closing line breaks.  Sizes and digests are made before
    the join, so a reader of those alone doesn't move payloads.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(
        F.col("digest").alias("key"),
        "payload",
        F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )
    page = F.regexp_extract(field("WARC-Record-ID"), "^<urn:page:(.*)>$", 1)
    refers = F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(.*)>$", 1)
    headers = spark.read.parquet(f"{path}/headers").select(
        "digest",
        "header",
        F.when(page != "", page).cast("bigint").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers).cast("bigint").alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("named"),
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return headers.join(stored, F.col("digest") == F.col("key")).select(
        "page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest",
        (F.col("named") == F.col("payload_digest")).alias("verified"),
        "payload",
        F.concat("header", body, F.lit("\r\n\r\n").cast("binary")).alias("record"),
    )
