"""Node relation -> HTML text (C6) and the table tidy of the Simple HTML output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nodes import ordered_concat

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
TABLE_STRUCTURE = ["table", "thead", "tbody", "tfoot", "tr"]
# ---------------------------------------------------------------------------------------------------------------


def escape_text(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit(" "), F.lit("&nbsp;"))


def escape_attr(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit('"'), F.lit("&quot;"))
    return F.replace(c, F.lit(" "), F.lit("&nbsp;"))


def attrs_html(attrs: Column) -> Column:
    """`` k="v"`` for every attribute, in source order."""
    return F.coalesce(F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat(
        F.lit(" "), e["key"], F.lit('="'), escape_attr(e["value"]), F.lit('"'))), ""), F.lit(""))


def token_html(kind: Column, tag: Column, attrs: Column, text: Column, matched: Column) -> Column:
    """One token re-spelled: tags lower-cased, attributes quoted, text escaped; unmatched closers vanish."""
    return (F.when(kind == "text", escape_text(text))
             .when(kind.isin("open", "void"), F.concat(F.lit("<"), tag, attrs_html(attrs), F.lit(">")))
             .when((kind == "close") & matched, F.concat(F.lit("</"), tag, F.lit(">")))
             .otherwise(F.lit("")))


def to_html(nodes: DataFrame, docs: DataFrame | None = None, out_col: str = "html") -> DataFrame:
    """``body.innerHTML`` of each document - one ordered concatenation per document (bounded by A6)."""
    piece = token_html(F.col("kind"), F.col("tag"), F.col("attrs"), F.col("text"), F.col("matched"))
    before = F.coalesce(escape_text(F.col("before")), F.lit("")) if "before" in nodes.columns else F.lit("")
    out = nodes.groupBy("doc_id").agg(ordered_concat(F.col("pos"), F.concat(before, piece)).alias(out_col))
    if docs is not None:
        out = docs.select("doc_id").join(out, "doc_id", "left") \
                  .select("doc_id", F.coalesce(F.col(out_col), F.lit("")).alias(out_col))
    return out
