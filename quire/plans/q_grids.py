"""Grid repairs and renderings: F1 selection overlap, G2/F2 table swap, E3 ARIA rows -> table, B7/B8 grid
entries, F3 grid injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators.nodes import to_nodes, with_spans, with_tree
from . import duck as D
from . import fixtures as X
from .q_aria import ROLE, a, d_aria_cells, d_element_texts, d_tree, fx3_tree
from .q_tables import d_native_cells
from .registry import query

MO, MC = "(kind = 'open' AND matched)", "(kind = 'close' AND matched)"
RUN = f"OVER (PARTITION BY doc_id ORDER BY pos {D.RUN})"


def fx1_tree(spark, sf):
    return with_tree(with_spans(to_nodes(X.fx1_native_tables(spark, sf))))


# ---------------------------------------------------------------------------------------------------------------
# F1

def _selections(cells):
    """Two selection ranges per document derived from its cell positions."""
    b = cells.groupBy("doc_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    ranges = F.array(*[F.struct(a.alias("start_pos"), z.alias("end_pos")) for a, z in ((lo + 5, lo + 20), (hi - 3, hi - 1))])
    return b.select("doc_id", F.inline(ranges))


@query("f1_mark_selected", oracle=lambda: (lambda h: f"""{h[0]},
cells AS (SELECT doc_id, pos, end_pos FROM {h[1]} WHERE tag IN ('td', 'th') AND {MO}),
b AS (SELECT doc_id, min(pos) AS lo, max(pos) AS hi FROM cells GROUP BY doc_id),
sel AS (SELECT doc_id, lo + 5 AS start_pos, lo + 20 AS end_pos FROM b
        UNION ALL SELECT doc_id, hi - 3, hi - 1 FROM b)
SELECT c.doc_id, c.pos, EXISTS (SELECT 1 FROM sel s WHERE s.doc_id = c.doc_id AND c.pos <= s.end_pos
                                 AND c.end_pos >= s.start_pos) AS selected FROM cells c""")(d_tree(X.DUCK["fx1"])))
def f1_mark_selected(spark, sf):
    """which cells intersect any selection range (ranges and cells as one relation in document order)."""
    t = fx1_tree(spark, sf)
    cells = t.filter(F.col("tag").isin("td", "th") & (F.col("kind") == "open") & F.col("matched")) \
             .select("doc_id", "pos", "end_pos")
    return G.mark_selected(cells, _selections(cells)).select("doc_id", "pos", "selected")


# ---------------------------------------------------------------------------------------------------------------
# G2 / F2

def _payload_and_grid(spark, sf):
    payload = G.native_cells(fx1_tree(spark, sf)).select("doc_id", "table_no", "r", "c", "text")
    grid = X.fx8_cells(spark, sf).select("doc_id", "table_no", "r", "c", "text", "strategy")
    return payload, grid


def _d_payload_grid():
    head, tree = d_tree(X.DUCK["fx1"])
    return f"""{head},{d_native_cells(tree)},
pc AS (SELECT doc_id, table_no, r, c, text FROM native_cells),
gc AS (SELECT doc_id, table_no, r, c, text, strategy FROM {X.DUCK['fx8']}),
pw AS (SELECT doc_id, table_no, max(w) AS clip_cols FROM (SELECT doc_id, table_no, r, count(*) AS w FROM pc
       GROUP BY doc_id, table_no, r) GROUP BY doc_id, table_no),
gw AS (SELECT g.doc_id, g.table_no, count(*) AS dom_cols FROM gc g
       WHERE g.r = (SELECT min(r) FROM gc g2 WHERE g2.doc_id = g.doc_id AND g2.table_no = g.table_no)
       GROUP BY g.doc_id, g.table_no),
guard AS (SELECT pw.doc_id, bool_and(NOT (coalesce(gw.dom_cols, 0) > 0 AND pw.clip_cols > coalesce(gw.dom_cols, 0) * 2))
            AS ok, count(*) AS n_tables
          FROM pw LEFT JOIN gw ON pw.doc_id = gw.doc_id AND pw.table_no = gw.table_no GROUP BY pw.doc_id),
docs AS (SELECT p.doc_id FROM (SELECT doc_id, count(DISTINCT table_no) AS n FROM pc GROUP BY doc_id) p
         JOIN (SELECT doc_id, count(DISTINCT table_no) AS n, bool_and(strategy = 'native') AS native FROM gc
               GROUP BY doc_id) g ON p.doc_id = g.doc_id
         JOIN guard ON guard.doc_id = p.doc_id WHERE g.native AND p.n = g.n AND guard.ok)"""


@query("g2_width_guard", oracle=lambda: _d_payload_grid() + "\nSELECT doc_id, ok, n_tables FROM guard")
def g2_width_guard(spark, sf):
    """Per document, may the payload tables be swapped for the page's (no layout table > 2x wider)?"""
    payload, grid = _payload_and_grid(spark, sf)
    return G.width_guard(payload, grid)


@query("f2_swap_tables", oracle=lambda: _d_payload_grid() + """
SELECT doc_id, table_no, r, c, text, false AS swapped FROM pc WHERE doc_id NOT IN (SELECT doc_id FROM docs)
UNION ALL SELECT doc_id, table_no, r, c, text, true FROM gc WHERE doc_id IN (SELECT doc_id FROM docs)""")
def f2_swap_tables(spark, sf):
    """all-or-nothing positional swap of payload tables for the page's native tables."""
    payload, grid = _payload_and_grid(spark, sf)
    return G.swap_tables(payload, grid)


# ---------------------------------------------------------------------------------------------------------------
# E3

def _d_table_html(cells, rk, ck, hr, hc, group="doc_id"):
    esc = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(160), '&nbsp;')"
    td = f"CASE WHEN {hc} THEN '<th>' ELSE '<td>' END || {esc} || CASE WHEN {hc} THEN '</th>' ELSE '</td>' END"
    return f"""
rws AS (SELECT {group}, {rk} AS rk, string_agg({td}, '' ORDER BY {ck}) AS tds, max(CAST({hr} AS INTEGER)) AS hdr
        FROM {cells} GROUP BY {group}, {rk}),
tbl AS (SELECT {group}, coalesce(string_agg(CASE WHEN hdr = 1 THEN '<tr>' || tds || '</tr>' END, '' ORDER BY rk), '') AS head,
               coalesce(string_agg(CASE WHEN hdr = 0 THEN '<tr>' || tds || '</tr>' END, '' ORDER BY rk), '') AS body
        FROM rws GROUP BY {group}),
tables AS (SELECT {group}, '<table>' || CASE WHEN head <> '' THEN '<thead>' || head || '</thead>' ELSE '' END ||
           '<tbody>' || body || '</tbody></table>' AS table_html FROM tbl)"""


def _d_e3():
    head, tree = d_tree(X.DUCK["fx3"])
    is_row = f"({ROLE} = 'row')"
    role_cell = f"({ROLE} IN {D.in_list(G.ARIA_ROW_CELL_ROLES)} AND _wd > 0)"
    child_cell = f"(_wd > 0 AND NOT _row_has_cells AND kind = 'open' AND matched AND parent_pos = row_pos)"
    et = d_element_texts("e3c", "e3", f"{role_cell} OR {child_cell}", {
        "row_pos": "row_pos", "is_header": f"({ROLE} = 'columnheader')"})
    return f"""{head},
e3a AS (SELECT *, max(CAST(tag = 'table' AND kind = 'open' AS INTEGER)) OVER (PARTITION BY doc_id) = 1 AS _has_table,
    max(CAST({is_row} AND {MO} AS INTEGER)) OVER (PARTITION BY doc_id) = 1 AS _has_rows FROM {tree}),
e3b AS (SELECT *, sum(CASE WHEN {is_row} AND {MO} THEN 1 WHEN {is_row} AND {MC} THEN -1 ELSE 0 END) {RUN} AS _wd,
    last_value(CASE WHEN {is_row} AND {MO} THEN pos END IGNORE NULLS) {RUN} AS row_pos
  FROM e3a WHERE _has_rows AND NOT _has_table),
e3c AS (SELECT *, max(CAST({role_cell} AS INTEGER)) OVER (PARTITION BY doc_id, row_pos) = 1 AS _row_has_cells
  FROM e3b),{et},
e3cells AS (SELECT doc_id, row_pos, el_pos, is_header, text,
    max(CAST(is_header AS INTEGER)) OVER (PARTITION BY doc_id, row_pos) = 1 AS header_row FROM e3_out),
{_d_table_html('e3cells', 'row_pos', 'el_pos', 'header_row', 'is_header')}"""


@query("e3_aria_tables", oracle=lambda: _d_e3() + "\nSELECT doc_id, table_html FROM tables")
def e3_aria_tables(spark, sf):
    """Loose ARIA rows (no native table in the document) rebuilt as one table; header rows in thead."""
    cells = G.aria_row_cells(fx3_tree(spark, sf))
    return G.rows_to_table_html(cells, "row_pos", "el_pos", "header_row", "is_header")


# ---------------------------------------------------------------------------------------------------------------
# B7 / B8 / F3 over the ARIA grid (E9 + E10)

def _d_grid():
    head, tree = d_tree(X.DUCK["fx3"])
    return f"""{head},{d_aria_cells(tree)},
grid AS (SELECT g.doc_id, g.table_no, g.r - g.r0 AS r, g.c - g.c0 AS c, coalesce(s.text, '') AS text
FROM (SELECT doc_id, table_no, r0, c0, r, unnest(generate_series(c0, c1)) AS c
      FROM (SELECT doc_id, table_no, r0, c0, c1, unnest(generate_series(r0, r1)) AS r
            FROM (SELECT doc_id, table_no, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1
                  FROM aria_cells WHERE selected GROUP BY doc_id, table_no))) g
LEFT JOIN (SELECT * FROM aria_cells WHERE selected) s
  ON s.doc_id = g.doc_id AND s.table_no = g.table_no AND s.r = g.r AND s.c = g.c)"""


def aria_grid(spark, sf):
    return G.repair_grid(G.aria_cells(fx3_tree(spark, sf)))


@query("b7_grid_markdown", oracle=lambda: _d_grid() + """
SELECT doc_id, string_agg(line, chr(10) ORDER BY r) AS markdown FROM (
  SELECT doc_id, r, CASE WHEN r = 0 THEN l || chr(10) || '| ' || array_to_string(repeat(['---'], CAST(n AS BIGINT)), ' | ')
                         || ' |' ELSE l END AS line
  FROM (SELECT doc_id, r, count(*) AS n,
          '| ' || string_agg(regexp_replace(text, '\\s*\\n\\s*', '<br>', 'g'), ' | ' ORDER BY c) || ' |' AS l
        FROM grid WHERE table_no = 0 GROUP BY doc_id, r)) GROUP BY doc_id""")
def b7_grid_markdown(spark, sf):
    """The first grid table as GFM Markdown (first row promoted when the grid has no header)."""
    return G.grid_markdown(aria_grid(spark, sf))


@query("b8_grid_html", oracle=lambda: _d_grid() + ",\n" + _d_table_html(
    "(SELECT *, r = 0 AS h FROM grid WHERE table_no = 0)", "r", "c", "h", "h").lstrip("\n")
    + "\nSELECT doc_id, table_html AS simple_html FROM tables")
def b8_grid_html(spark, sf):
    """The first grid table as Simple HTML."""
    return G.grid_simple_html(aria_grid(spark, sf))


@query("f3_inject_grids", oracle=lambda: _d_grid() + ",\n" + _d_table_html(
    "(SELECT *, r = 0 AS h FROM grid)", "r", "c", "h", "h", group="doc_id, table_no").lstrip("\n") + f"""
SELECT p.doc_id, coalesce(t.html, p.html) AS html, t.html IS NOT NULL AS injected
FROM {X.DUCK['fx3']} p
LEFT JOIN (SELECT doc_id, string_agg(table_html, '' ORDER BY table_no) AS html FROM tables GROUP BY doc_id) t
  ON p.doc_id = t.doc_id
WHERE NOT regexp_matches(p.html, '(?i)<table\\b')""")
def f3_inject_grids(spark, sf):
    """a payload with no table whose page has grid cells gets the grid tables as its whole body (the prose
    is lost, as in the reference); other payloads pass unchanged."""
    payloads = X.fx3_aria_grids(spark, sf).filter(~F.col("html").rlike("(?i)<table\\b"))
    grid = aria_grid(spark, sf).withColumn("h", F.col("r") == 0)
    tables = G.rows_to_table_html(grid, "r", "c", "h", "h", group=("doc_id", "table_no"))
    injected = tables.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("table_no", "table_html"))), lambda s: s["table_html"]), "").alias("grid_html"))
    j = payloads.join(injected, "doc_id", "left")
    return j.select("doc_id", F.coalesce("grid_html", "html").alias("html"),
                    F.col("grid_html").isNotNull().alias("injected"))
