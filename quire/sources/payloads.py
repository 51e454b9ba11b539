"""Payload sources and sinks.

A payload row is ``(doc_id, url, html, plain, extras)``; an entry is present iff its column is non-NULL, so
presence and emptiness stay apart (M2) - nothing here coalesces early.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MAX_PAYLOAD_CHARS

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
ADMITTED_URL = "^(https?|file):"
PLAIN_TYPE, HTML_TYPE = "text/plain", "text/html"
EXTRAS = "array<struct<type:string,bytes:binary>>"
# ---------------------------------------------------------------------------------------------------------------


def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet", mapping: dict | None = None) -> DataFrame:
    """A1: read a payload store (parquet / json / orc) and project it onto the payload schema. ``mapping``
    renames source columns (``{"doc_id": "page_id", ...}``); a missing entry column becomes NULL, ``extras`` no blobs."""
    df = spark.read.format(fmt).load(path)
    mapping = mapping or {}
    cols = []
    for name, typ in (("doc_id", "bigint"), ("url", "string"), ("html", "string"), ("plain", "string")):
        src = mapping.get(name, name)
        cols.append((F.col(src) if src in df.columns else F.lit(None)).cast(typ).alias(name))
    extras = F.col(mapping.get("extras", "extras")) if mapping.get("extras", "extras") in df.columns else F.array()
    return df.select(*cols, extras.cast(EXTRAS).alias("extras"))


def split_entries(long_form: DataFrame) -> DataFrame:
    """A2: long form ``(doc_id, type, body)`` -> one row per payload: plain, html, other typed blobs.

    A conditional-aggregate pivot: one hash aggregate keyed by ``doc_id`` (partial aggregation map-side)."""
    t, b = F.col("type"), F.col("body")
    return (long_form.groupBy("doc_id").agg(
        F.max(F.when(t == PLAIN_TYPE, b.cast("string"))).alias("plain"),
        F.max(F.when(t == HTML_TYPE, b.cast("string"))).alias("html"),
        F.sort_array(F.collect_list(F.when(~t.isin(PLAIN_TYPE, HTML_TYPE),
                                           F.struct(t.alias("type"), b.cast("binary").alias("bytes")))))
         .alias("extras")))


def write_entries(entries: DataFrame, path: str, partition_by: str | None = "source_type", mode: str = "overwrite"):
    """A3: write both entries; an empty Simple HTML is written as NULL (the plain entry goes alone)."""
    out = entries.withColumn("simple_html", F.expr("nullif(simple_html, '')"))
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def replace_entries(entries: DataFrame, choose_md: Column, choose_html: Column) -> DataFrame:
    """A4: ``(doc_id, plain, html)`` where the chosen entries are replaced by their equivalents; a chosen one is
    created if absent, others are never conjured. Both equivalents and the old entries come from one pass: the old ones
    travel as facts of the document's marker."""
    from ..operators.derive import entries_of, source_nodes
    named = lambda c, k: F.when(c, F.lit(k))
    facts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("plain", "html", "md", "sh"))), F.array(
        F.col("plain"), F.col("html"), named(choose_md, "1"), named(choose_html, "1"))), lambda k, v: v.isNotNull())
    out = entries_of(source_nodes(entries.withColumn("facts", facts), facts_col="facts"))
    was = lambda k: F.col("facts")[k]
    return out.select("doc_id", F.when(was("md").isNotNull(), F.col("markdown")).otherwise(was("plain")).alias("plain"),
                      F.when(was("sh").isNotNull(), F.col("simple_html")).otherwise(was("html")).alias("html"))


def restore_entries(current: DataFrame, first_read: DataFrame, keys: DataFrame) -> DataFrame:
    """A5: the entries of the documents in ``keys`` as they were first read (absent ones absent again), the others as
    they are."""
    back = first_read.join(keys.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.struct("plain", "html").alias("_back"))
    old = F.col("_back").isNotNull()
    return current.join(back, "doc_id", "left").select("doc_id", *[F.when(old, F.col("_back")[c]).otherwise(F.col(c)).alias(c) for c in ("plain", "html")])


def oversize(col: Column, limit: int = MAX_PAYLOAD_CHARS) -> Column:
    return F.length(col) > limit


def quarantine_oversize(df: DataFrame, col: str, limit: int = MAX_PAYLOAD_CHARS) -> tuple[DataFrame, DataFrame]:
    """(admitted, dead_letter). Both are filters over the same scan; every row is in one of them."""
    big = F.coalesce(oversize(F.col(col), limit), F.lit(False))
    return df.filter(~big), df.filter(big).withColumn("reason", F.lit("oversize"))


def admitted_url(url: Column) -> Column:
    """Only http, https and file URLs."""
    return F.coalesce(url.rlike(ADMITTED_URL), F.lit(False))


def read_corpus_dir(spark: SparkSession, root: str) -> DataFrame:
    """A directory of captured documents (``<slug>/input.html``, ``expected.md``, ...) as one row per slug,
    file bodies pivoted by file name. ``binaryFile`` lists and reads in parallel."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
                  .select(F.regexp_extract("path", "([^/]+)/([^/]+)$", 1).alias("slug"),
                          F.regexp_extract("path", "([^/]+)$", 1).alias("file"),
                          F.col("content").cast("string").alias("body")))
    return (files.groupBy("slug").agg(*[F.max(F.when(F.col("file") == f, F.col("body"))).alias(a) for f, a in (
        ("input.html", "input_html"), ("expected.md", "expected_md"), ("expected.simple.html", "expected_simple_html"),
        ("fixture.json", "fixture_json"), ("notes.md", "notes"))]))
