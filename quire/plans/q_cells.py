"""Cell-relation queries over FX8 (a ragged selection in one table per region): G1, E10, K12, G10, G3-G5, E11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from . import fixtures as X
from .registry import query

FX8 = X.DUCK["fx8"]

D_BOX = f"""(SELECT doc_id, table_no, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1
  FROM {FX8} WHERE selected GROUP BY doc_id, table_no)"""

D_REPAIRED = f"""(SELECT g.doc_id, g.table_no, g.r - g.r0 AS r, g.c - g.c0 AS c, coalesce(s.text, '') AS text
  FROM (SELECT doc_id, table_no, r0, c0, r, unnest(generate_series(c0, c1)) AS c
        FROM (SELECT doc_id, table_no, r0, c0, c1, unnest(generate_series(r0, r1)) AS r FROM {D_BOX})) g
  LEFT JOIN (SELECT * FROM {FX8} WHERE selected) s
    ON s.doc_id = g.doc_id AND s.table_no = g.table_no AND s.r = g.r AND s.c = g.c)"""


def fx8_repaired(spark, sf):
    return G.repair_grid(X.fx8_cells(spark, sf)).select("doc_id", "table_no", "r", "c", "text")


@query("g1_bounding_box", oracle=lambda: f"SELECT * FROM {D_BOX}")
def g1_bounding_box(spark, sf):
    return G.bounding_box(X.fx8_cells(spark, sf))


@query("e10_repair_grid", oracle=lambda: f"SELECT doc_id, table_no, r, c, text FROM {D_REPAIRED}")
def e10_repair_grid(spark, sf):
    return fx8_repaired(spark, sf)


@query("k12_cells_markdown", oracle=lambda: f"""
SELECT doc_id, table_no, string_agg(line, chr(10) ORDER BY r) AS markdown FROM (
  SELECT doc_id, table_no, r,
    CASE WHEN r = 0 THEN l || chr(10) || '| ' || array_to_string(repeat(['---'], CAST(n AS BIGINT)), ' | ') || ' |'
         ELSE l END AS line
  FROM (SELECT doc_id, table_no, r, count(*) AS n,
          '| ' || string_agg(regexp_replace(text, '\\s*\\n\\s*', '<br>', 'g'), ' | ' ORDER BY c) || ' |' AS l
        FROM {D_REPAIRED} GROUP BY doc_id, table_no, r))
GROUP BY doc_id, table_no""")
def k12_cells_markdown(spark, sf):
    return G.cells_to_markdown(fx8_repaired(spark, sf))


@query("g10_ragged_report", oracle=lambda: f"""
SELECT doc_id, table_no, min(w) AS min_w, max(w) AS max_w, min(w) <> max(w) AS ragged
FROM (SELECT doc_id, table_no, r, count(*) AS w FROM {FX8} WHERE selected GROUP BY doc_id, table_no, r)
GROUP BY doc_id, table_no""")
def g10_ragged_report(spark, sf):
    return G.ragged_report(X.fx8_cells(spark, sf).filter("selected"))


@query("g3_snapshot_stats", oracle=lambda: f"""
SELECT doc_id, count(*) AS cell_count, count(DISTINCT (table_no, r)) AS row_count FROM {D_REPAIRED} GROUP BY doc_id""")
def g3_snapshot_stats(spark, sf):
    return G.snapshot_stats(fx8_repaired(spark, sf))


@query("g4_rows_of", oracle=lambda: f"""
SELECT doc_id, table_no, r, list(text ORDER BY c) AS cells FROM {D_REPAIRED} GROUP BY doc_id, table_no, r""")
def g4_rows_of(spark, sf):
    return G.rows_of(fx8_repaired(spark, sf))


@query("g5_selected_columns", oracle=lambda: f"SELECT DISTINCT doc_id, table_no, c FROM {FX8} WHERE selected")
def g5_selected_columns(spark, sf):
    return G.selected_columns(X.fx8_cells(spark, sf))


@query("e11_promote_first_row", oracle=lambda: f"""
SELECT doc_id, table_no, r, c, h AS is_header, CASE WHEN h THEN 'thead' ELSE section END AS section, text FROM (
  SELECT *, is_header OR (max(CAST(is_header AS INTEGER)) OVER (PARTITION BY doc_id, table_no) <> 1
                          AND r = min(r) OVER (PARTITION BY doc_id, table_no)) AS h
  FROM {FX8})""")
def e11_promote_first_row(spark, sf):
    return G.promote_first_row(X.fx8_cells(spark, sf)).select("doc_id", "table_no", "r", "c", "is_header",
                                                              "section", "text")
