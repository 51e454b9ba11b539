"""Routing and the entries job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tsv import is_tsv

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results (lineage labels).
SOURCE_HTML = "HTML"
SOURCE_ARIA = "HTML (Extracted ARIA Table)"
SOURCE_TSV = "Plain Text (TSV Conversion)"
DERIVED_HTML, DERIVED_PLAIN = "text/html", "text/plain"
# ---------------------------------------------------------------------------------------------------------------


def route(html: Column, plain: Column) -> Column:
    """B1: HTML first; else plain text when it is TSV; else nothing."""
    return (F.when(html.isNotNull() & (html != ""), F.lit("html"))
             .when(is_tsv(html, plain), F.lit("tsv"))
             .otherwise(F.lit("none")))


def hotkey_route(html: Column, plain: Column, has_grid: Column) -> Column:
    """B2: html -> grid rebuilt from the page (no html) -> TSV -> plain rewrite -> nothing. Grid beats TSV."""
    return (F.when(html.isNotNull() & (html != ""), F.lit("html"))
             .when(F.coalesce(has_grid, F.lit(False)), F.lit("grid"))
             .when(is_tsv(html, plain), F.lit("tsv"))
             .when(plain.isNotNull() & (plain != ""), F.lit("plain"))
             .otherwise(F.lit("none")))


def with_grid_flag(payloads: DataFrame, cells: DataFrame) -> DataFrame:
    """``has_grid`` by a left join to the distinct documents that have cells."""
    docs = cells.select("doc_id").distinct().withColumn("has_grid", F.lit(True))
    return payloads.join(docs, "doc_id", "left").withColumn("has_grid", F.coalesce("has_grid", F.lit(False)))


def blank_to_empty(c: Column) -> Column:
    """A Simple HTML that is only whitespace becomes '' (no html entry)."""
    return F.when(F.trim(F.regexp_replace(c, "\\s", " ")) == "", F.lit("")).otherwise(c)
