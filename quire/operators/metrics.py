"""Size and presence reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_bytes, utf8_bytes

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
RATIO_REPORTED_FROM = 10     # markup-to-text ratio shown when at least this
SAVINGS_REPORTED_FROM = 1    # percent smaller shown when at least this
# ---------------------------------------------------------------------------------------------------------------


def payload_metrics(df: DataFrame, source: str, derived: str, text: str, source_is_bytes: bool = False) -> DataFrame:
    """Bytes of the source and of the derived entry, markup ratio against the text it carries, savings.
    ``source_is_bytes``: the source column already holds the byte size (so a join never has to move the text)."""
    sb = F.col(source) if source_is_bytes else utf8_bytes(F.coalesce(F.col(source), F.lit("")))
    db, tb = utf8_bytes(F.coalesce(F.col(derived), F.lit(""))), utf8_bytes(F.coalesce(F.col(text), F.lit("")))
    ratio = F.round(sb / tb).cast("bigint")
    pct = F.round((1 - db / sb) * 100).cast("bigint")
    return df.select("*", sb.alias("source_bytes"), db.alias("derived_bytes"),
                     format_bytes(sb).alias("source_size"), format_bytes(db).alias("derived_size"),
                     F.when((tb > 0) & (ratio >= RATIO_REPORTED_FROM), ratio).alias("markup_ratio"),
                     F.when((sb > 0) & (pct >= SAVINGS_REPORTED_FROM), pct).alias("savings_pct"))


def presence_class(plain: Column, html: Column) -> Column:
    """Which entries the payload carries."""
    p, h = plain.isNotNull(), html.isNotNull()
    return (F.when(p & h, F.lit("both")).when(p, F.lit("plain only")).when(h, F.lit("html only"))
             .otherwise(F.lit("none")))


def presence_report(df: DataFrame) -> DataFrame:
    """G8 corpus report: documents per presence class and route, with rollup subtotals (``rollup`` is two
    aggregation levels in one Expand + hash aggregate)."""
    return (df.rollup("presence", "route").agg(F.count(F.lit(1)).alias("n_docs"),
                                               F.sum(F.col("inert").cast("int")).alias("n_inert")))
