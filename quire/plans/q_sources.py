"""Payload entries: split by type, write / read back, replace and undo, presence report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tsv as T
from ..operators import derive as DV
from ..operators import entries as EN
from ..operators import metrics as MET
from ..sources import payloads as P
from ..streaming.jobs import new_run_dir
from . import fixtures as X
from .q_payloads import _d_tsv_html, _d_tsv_md, d_is_tsv
from .q_repair import d_chain
from .q_tables import d_markdown_chain
from .registry import query


def _long_form(spark, sf):
    e = X.fx11_entries(spark, sf)
    plain = e.filter(F.col("plain").isNotNull()).select("doc_id", F.lit(P.PLAIN_TYPE).alias("type"),
                                                        F.col("plain").alias("body"))
    html = e.filter(F.col("html").isNotNull()).select("doc_id", F.lit(P.HTML_TYPE).alias("type"),
                                                      F.col("html").alias("body"))
    blob = e.filter(F.col("doc_id") % 10 == 0).select("doc_id", F.lit("image/png").alias("type"),
                                                      F.concat(F.lit("png:"), F.col("doc_id").cast("string"))
                                                      .alias("body"))
    return plain.unionByName(html).unionByName(blob)


@query("a2_split_entries", oracle=lambda: f"""
WITH lf AS (
  SELECT doc_id, 'text/plain' AS type, plain AS body FROM {X.DUCK['fx11']} WHERE plain IS NOT NULL
  UNION ALL SELECT doc_id, 'text/html', html FROM {X.DUCK['fx11']} WHERE html IS NOT NULL
  UNION ALL SELECT doc_id, 'image/png', 'png:' || doc_id FROM {X.DUCK['fx11']} WHERE doc_id % 10 = 0)
SELECT doc_id, max(CASE WHEN type = 'text/plain' THEN body END) AS plain,
       max(CASE WHEN type = 'text/html' THEN body END) AS html,
       count(*) FILTER (WHERE type NOT IN ('text/plain', 'text/html')) AS n_extras,
       coalesce(string_agg(CASE WHEN type NOT IN ('text/plain', 'text/html') THEN type END, ',' ORDER BY type), '')
         AS extra_types
FROM lf GROUP BY doc_id""")
def a2_split_entries(spark, sf):
    """A1/A2: typed entries (long form) pivoted to one payload row: plain, html and the other blobs."""
    s = P.split_entries(_long_form(spark, sf))
    return s.select("doc_id", "plain", "html", F.size("extras").cast("bigint").alias("n_extras"),
                    F.array_join(F.transform("extras", lambda e: e["type"]), ",").alias("extra_types"))


@query("a3_write_read", oracle=lambda: f"""
SELECT m.doc_id, m.markdown, nullif(h.simple_html, '') AS simple_html, 'Plain Text (TSV Conversion)' AS source_type
FROM ({_d_tsv_md()}) m JOIN ({_d_tsv_html()}) h ON m.doc_id = h.doc_id""")
def a3_write_read(spark, sf):
    """A3: TSV-derived entries written partitioned by lineage, then read back (empty Simple HTML -> NULL)."""
    tsv = X.fx4_tsv(spark, sf).select("doc_id", T.tsv_to_markdown(F.col("plain")).alias("markdown"),
                                      T.tsv_to_html(F.col("plain")).alias("simple_html"),
                                      F.lit(EN.SOURCE_TSV).alias("source_type"))
    path = new_run_dir(spark, "a3") + "/entries"
    P.write_entries(tsv, path)
    return spark.read.parquet(path).select("doc_id", "markdown", "simple_html", "source_type")


def replaced(spark, sf):
    """A4: choices by ``doc_id % 3`` (markdown / simple html / both)."""
    k = F.col("doc_id") % 3
    return P.replace_entries(X.fx11_entries(spark, sf), k.isin(0, 2), k.isin(1, 2))


def _d_replaced():
    src = (f"(SELECT doc_id, html FROM {X.DUCK['fx11']} WHERE html IS NOT NULL AND html <> '')")
    md_sql, md_out = d_markdown_chain(src)
    sh = d_chain(src, "e6", "simple_html", blank_empty=True)
    return f"""(SELECT e.doc_id,
  CASE WHEN e.doc_id % 3 IN (0, 2) THEN coalesce(m.markdown, '') WHEN e.plain IS NOT NULL THEN e.plain END AS plain,
  CASE WHEN e.doc_id % 3 IN (1, 2) THEN coalesce(s.simple_html, '') WHEN e.html IS NOT NULL THEN e.html END AS html
FROM {X.DUCK['fx11']} e
LEFT JOIN ({md_sql}
SELECT doc_id, markdown FROM {md_out}) m ON e.doc_id = m.doc_id
LEFT JOIN ({sh}) s ON e.doc_id = s.doc_id)"""


@query("a4_replace", oracle=lambda: f"SELECT doc_id, plain, html FROM {_d_replaced()}")
def a4_replace(spark, sf):
    """A4: replace entries with equivalents; a chosen entry is created if absent, others never conjured."""
    return replaced(spark, sf)


@query("a5_restore", oracle=lambda: f"""
SELECT r.doc_id, CASE WHEN r.doc_id % 2 = 0 THEN e.plain ELSE r.plain END AS plain,
       CASE WHEN r.doc_id % 2 = 0 THEN e.html ELSE r.html END AS html
FROM {_d_replaced()} r JOIN {X.DUCK['fx11']} e ON r.doc_id = e.doc_id""")
def a5_restore(spark, sf):
    """A5: undo for the documents asked (even ids): back to the first-read entries, absent ones stay absent."""
    raw = X.fx11_entries(spark, sf)
    return P.restore_entries(replaced(spark, sf), raw, raw.filter(F.col("doc_id") % 2 == 0))


@query("g8_presence", oracle=lambda: f"""
SELECT presence, route, count(*) AS n_docs, sum(CAST(route = 'none' AS INTEGER)) AS n_inert FROM (
  SELECT CASE WHEN plain IS NOT NULL AND html IS NOT NULL THEN 'both' WHEN plain IS NOT NULL THEN 'plain only'
              WHEN html IS NOT NULL THEN 'html only' ELSE 'none' END AS presence,
         CASE WHEN html IS NOT NULL AND html <> '' THEN 'html' WHEN {d_is_tsv('html', 'plain')} THEN 'tsv'
              ELSE 'none' END AS route
  FROM {X.DUCK['fx11']}) GROUP BY ROLLUP (presence, route)""")
def g8_presence(spark, sf):
    """Corpus report of entry presence and derivation route, with rollup subtotals."""
    e = X.fx11_entries(spark, sf)
    d = e.select(MET.presence_class(F.col("plain"), F.col("html")).alias("presence"),
                 EN.route(F.col("html"), F.col("plain")).alias("route"))
    d = d.withColumn("inert", F.col("route") == "none")
    return MET.presence_report(d)
