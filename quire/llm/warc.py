"""Content-addressed WARC archive.

An archive is a folder of two tables in the store that Spark writes to:

* ``payloads(digest, payload)`` holds the bytes of every payload once, under its SHA-256;
* ``records(record_no, page_id, url, header, http, stored, refers_to)`` holds of every record the exact WARC header,
  the exact HTTP header, and, for a record with a body, the digest under which the body is stored.

Payloads are told apart by digests alone, so copies of one page never meet in a task: digests are aggregated, and
the payload of each digest is taken from the page that the aggregate names. Reading joins bodies back to headers,
checks every body against the digest it is stored under and against the digest and the length that the header
states, and rebuilds the record's bytes. A record that fails a check stops the read.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the largest page_id is the response and
the others are revisits of it; smaller payloads are responses throughout.

Nulls and corner cases: a null html is an empty payload; a null url is an empty target; null page_ids sort below
all others, and rows that repeat a page_id get records of their own. An empty table gives an empty archive. Only
``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch_table

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _record_id(no: Column) -> Column:
    """A name-based id of the form that WARC asks for, from the record's own key."""
    h = F.md5(no)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _key(page_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.lit("page"), page_id.cast("string"), sha)


def write_archive(pages: DataFrame, path: str, date: str = DATE, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the records of ``pages(page_id, url, html)`` to the archive at ``path``."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"))
    facts = pages.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    facts.write.option("compression", "zstd").parquet(f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts")

    # of each payload, the page that speaks for it; rows that repeat a page_id and a payload are one here
    best = facts.groupBy("sha256").agg(F.max("page_id").alias("owner"), F.max(F.struct("page_id", "url")).alias("first"))
    # what is not stored: copies of the payload of another page. They are saved first, so that Spark knows their size:
    # where they are few, payloads are written where they are read and don't move
    key = F.coalesce("page_id", F.lit(-(1 << 63)))
    copies = facts.join(best.select("sha256", "owner"), "sha256").where(~F.col("page_id").eqNullSafe(F.col("owner")))
    copies = saved(copies.select(key.alias("key"), F.col("sha256").alias("digest")).distinct(), "warc-copies")
    mine = pages.select(key.alias("key"), F.sha2("payload", 256).alias("digest"), "payload").join(copies, ["key", "digest"], "left_anti")
    if facts.groupBy("page_id", "sha256").count().where("count > 1").limit(1).count():  # rows that repeat page and payload
        mine = mine.dropDuplicates(["key", "digest"])
    mine.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    best = best.select(F.col("sha256"), "owner", F.col("first.url").alias("owner_url"))
    x = facts.join(best, "sha256")
    revisit = (F.col("n") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(_key(F.col("page_id"), F.col("sha256")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(_key(F.col("owner"), F.col("sha256")))),
            line("WARC-Refers-To-Target-URI", F.col("owner_url")),
            line("WARC-Refers-To-Date", F.lit(date)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
        F.lit(CRLF))
    x.select("page_id", header.alias("header"), http.alias("http"), F.when(~revisit, F.col("sha256")).alias("stored"),
             F.when(revisit, F.col("owner")).alias("refers_to"), F.when(revisit, F.col("sha256")).alias("same_as")).write.option("compression", "zstd").parquet(f"{path}/records")


def header_field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_type, refers_to, payload_digest, payload_bytes, record``: the records of the archive, their
    bytes put together from header and stored body and checked. For a revisit, digest and length are those of the
    body that it refers to."""
    records = spark.read.parquet(f"{path}/records")
    bodies = spark.read.parquet(f"{path}/payloads")
    sound = F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.concat(F.lit("stored payload does not match its digest "), F.col("digest")))
    bodies = bodies.select("digest", F.when(sound.isNull(), F.col("payload")).alias("payload"))
    r = records.where("stored is not null").join(bodies, F.col("stored") == F.col("digest"))
    full = r.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "header", "http", "payload")
    record = F.concat(F.encode(F.concat("header", "http"), "UTF-8"), F.col("payload"), F.encode(F.lit(CRLF * 2), "UTF-8"))
    full = full.withColumn("record", record)
    # from here on, all is read from the record's bytes
    at = F.octet_length("header") + F.octet_length("http")
    full = full.withColumn("body", F.expr("substring(record, octet_length(header) + octet_length(http) + 1, octet_length(record) - octet_length(header) - octet_length(http) - 4)"))
    stated = header_field(F.col("header"), "Content-Length").cast("long")
    digest = F.concat(F.lit("sha1:"), F.sha1("body"))
    full = full.where(F.assert_true((header_field(F.col("header"), "WARC-Payload-Digest") == digest) & (stated == at - F.octet_length("header") + F.octet_length("body")), "a record does not match its header").isNull())
    full = full.select("page_id", "record_type", "refers_to", F.sha1("body").alias("payload_digest"), F.octet_length("body").cast("long").alias("payload_bytes"), "record")

    sizes = bodies.select("digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    v = records.where("stored is null").join(sizes, F.col("same_as") == F.col("digest"))
    v = v.where(F.assert_true(header_field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")), "a revisit does not match its payload").isNull())
    record = F.encode(F.concat(F.col("header"), F.col("http"), F.lit(CRLF * 2)), "UTF-8")
    v = v.select("page_id", F.lit("revisit").alias("record_type"), F.col("refers_to").cast("long"), F.col("sha1").alias("payload_digest"), F.col("n").alias("payload_bytes"), record.alias("record"))
    return full.unionByName(v)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read its records back."""
    path = scratch_table(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)


ORACLE_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, sha256(body) AS k FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM o
"""
