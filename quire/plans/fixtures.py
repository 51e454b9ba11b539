"""Synthetic payloads derived from the driver tables (FX1-FX12).

``pages`` holds no table, image, ARIA role or tab-separated text, so the table / grid / image / style operators
run on payloads built here from the TPC-H-ish tables. Every fixture reads a table that grows with the scale factor,
whole, and its documents grow in number and not in size. Each builder has a DuckDB twin in :data:`DUCK` producing identical rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_table


def _agg_concat(order: Column, piece: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), piece.alias("v")))),
                                    lambda s: s["v"]), "")


def _block(key: str, size: int) -> Column:
    """Documents of ``size`` neighbouring keys."""
    return F.floor(F.col(key) / size).cast("bigint")


def _s(c) -> Column:
    return F.col(c).cast("string")


def fx1_native_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Native table with ``thead``, a style, and two ``div``s in the second cell; one doc per ten suppliers."""
    n = load_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    row = F.concat(F.lit("<tr><td>"), _s("s_suppkey"), F.lit("</td><td><div>"), F.col("s_name"),
                   F.lit("</div><div>r"), _s("s_nationkey"), F.lit("</div></td></tr>"))
    return (n.groupBy(_block("s_suppkey", 10).alias("doc_id"))
             .agg(F.concat(F.lit('<table style="border: 1px solid"><thead><tr><th>key</th><th>name</th></tr>'
                                 '</thead><tbody>'), _agg_concat(F.col("s_suppkey"), row),
                           F.lit("</tbody></table>")).alias("html")))


def fx2_headerless_tables(spark: SparkSession, sf: str) -> DataFrame:
    n = load_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    row = F.concat(F.lit("<tr><td>"), _s("s_suppkey"), F.lit("</td><td>"), F.col("s_name"), F.lit("</td></tr>"))
    return (n.groupBy(_block("s_suppkey", 10).alias("doc_id"))
             .agg(F.concat(F.lit("<table>"), _agg_concat(F.col("s_suppkey"), row), F.lit("</table>"))
                  .alias("html")))


def fx3_aria_grids(spark: SparkSession, sf: str) -> DataFrame:
    """ARIA grid after a lead paragraph; rows carry ``data-row``, cells ``data-col``; every third supplier
    is ``aria-selected``. One doc per nation and 200 keys."""
    s = load_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    sel = F.when(F.col("s_suppkey") % 3 == 0, F.lit(' aria-selected="true"')).otherwise(F.lit(""))
    dr = F.concat(F.lit(' data-row="'), _s("s_suppkey"), F.lit('"'))
    row = F.concat(F.lit('<div role="row"'), dr, F.lit('><span role="gridcell"'), dr, F.lit(' data-col="0"'),
                   sel, F.lit(">"), _s("s_suppkey"), F.lit('</span><span role="gridcell"'), dr, F.lit(' data-col="1"'),
                   sel, F.lit(">"), F.col("s_name"), F.lit("</span></div>"))
    head = ('<div role="row"><span role="columnheader" data-col="0">key</span>'
            '<span role="columnheader" data-col="1">name</span></div>')
    return (s.groupBy((F.col("s_nationkey") * 1_000_000 + _block("s_suppkey", 200)).cast("bigint").alias("doc_id"))
             .agg(F.concat(F.lit("<p>Suppliers of group "), F.col("doc_id").cast("string"),
                           F.lit('</p><div role="grid">' + head), _agg_concat(F.col("s_suppkey"), row),
                           F.lit("</div>")).alias("html")))


def fx4_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """Tab-separated text per nation and 200 keys; rows short / exact / long by ``s_suppkey % 3``."""
    s = load_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    k = F.col("s_suppkey") % 3
    line = F.concat(_s("s_suppkey"), F.lit("\t"), F.col("s_name"),
                    F.when(k == 1, F.lit("\tX")).when(k == 2, F.lit("\tX\textra")).otherwise(F.lit("")),
                    F.lit("\n"))
    return (s.groupBy((F.col("s_nationkey") * 1_000_000 + _block("s_suppkey", 200)).cast("bigint").alias("doc_id"))
             .agg(F.concat(F.lit("key\tname\tflag\n"), _agg_concat(F.col("s_suppkey"), line)).alias("plain")))


def fx5_images(spark: SparkSession, sf: str) -> DataFrame:
    """One image per part: 1x1 attributes / ``display: none`` / fractional style px / alt only / bare."""
    p = load_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    k = F.col("p_size") % 5
    src = F.concat(F.lit('<img src="https://img.example/'), _s("p_partkey"), F.lit('.png"'))
    extra = (F.when(k == 0, F.lit(' width="1" height="1"'))
              .when(k == 1, F.lit(' style="display: none"'))
              .when(k == 2, F.concat(F.lit(' style="width: '), _s("p_size"), F.lit('.5px; height: 10px"')))
              .when(k == 3, F.concat(F.lit(' alt="'), F.col("p_brand"), F.lit('"')))
              .otherwise(F.lit("")))
    img = F.concat(src, extra, F.lit(">"))
    # every seventh part links its image (a beacon inside a link leaves an empty anchor behind)
    img = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit('<a href="https://shop.example/'), _s("p_partkey"),
                                                     F.lit('"> '), img, F.lit(" </a>"))).otherwise(img)
    html = F.concat(F.lit("<p>"), F.col("p_name"), img, F.lit("</p>"))
    return p.select(F.col("p_partkey").alias("doc_id"), html.alias("html"))


def fx6_styles(spark: SparkSession, sf: str) -> DataFrame:
    """A style attribute per part with one refused declaration chosen by ``p_size % 4``."""
    p = load_table(spark, sf, "part", ["p_partkey", "p_size"])
    k = F.col("p_size") % 4
    style = (F.when(k == 0, F.lit("color: red !important; padding: 2px"))
              .when(k == 1, F.concat(F.lit("color: red; background-image: url(https://t.example/"), _s("p_partkey"),
                                     F.lit(".png); padding: 2px")))
              .when(k == 2, F.lit("--accent: blue; color: red; padding: 2px"))
              .otherwise(F.lit("position: fixed; color: red; padding: 2px")))
    return p.select(F.col("p_partkey").alias("doc_id"), style.alias("style"))


def fx7_cards(spark: SparkSession, sf: str) -> DataFrame:
    """News-card shaped payload per document: empty containers, a one-child div chain, a link around two
    block fields, then fake bold (even ids) or an icon-only link (odd ids)."""
    d = load_table(spark, sf, "documents", ["doc_id", "lang", "source"])
    tail = F.when(F.col("doc_id") % 2 == 0,
                  F.concat(F.lit('<b style="font-weight:normal">Source '), F.col("source"), F.lit("</b>"))) \
            .otherwise(F.concat(F.lit('<a href="https://more.example/'), _s("doc_id"),
                                F.lit('" aria-label="See more from '), F.col("source"),
                                F.lit('"><svg><path d="M0 0"></path></svg></a>')))
    html = F.concat(F.lit("<div><div><div></div> <section> </section></div><div><div><p>"), F.col("lang"),
                    F.lit('</p></div></div><a href="https://src.example/'), _s("doc_id"), F.lit('"><div>'),
                    F.col("source"), F.lit("</div>\n<div>"), F.col("lang"), F.lit("</div></a>"), tail,
                    F.lit("</div>"))
    return d.select("doc_id", html.alias("html"))


def fx8_cells(spark: SparkSession, sf: str) -> DataFrame:
    """``cells`` of one table per ten suppliers, numbered by key, three columns unpivoted; a ragged
    selection covers linear cell indexes 1..7 (row-major)."""
    n = load_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    from pyspark.sql import Window
    r = F.row_number().over(Window.partitionBy(_block("s_suppkey", 10)).orderBy("s_suppkey")) - 1
    n = n.withColumn("r", r.cast("int"))
    cells = n.select(_block("s_suppkey", 10).alias("doc_id"), "r", F.posexplode(F.array(
        _s("s_suppkey"), F.col("s_name"), _s("s_nationkey"))).alias("c", "text"))
    idx = F.col("r") * 3 + F.col("c")
    return cells.select("doc_id", F.lit(0).alias("table_no"), "r", F.col("c").cast("int").alias("c"),
                        F.lit("tbody").alias("section"), F.lit(False).alias("is_header"), "text",
                        idx.between(1, 7).alias("selected"), F.lit("native").alias("strategy"))


def fx9_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Payload pairs: same content respelled (``tbody``, ``meta``, comment + whitespace) or changed."""
    d = load_table(spark, sf, "documents", ["doc_id", "text"])
    words = F.regexp_replace(F.col("text"), "[<>&\\s]+", " ")
    left = F.concat(F.lit("<table><tr><td>"), words, F.lit("</td></tr></table>"))
    k = F.col("doc_id") % 5
    right = (F.when(k == 0, left)
              .when(k == 1, F.concat(F.lit("<table><tbody><tr><td>"), words, F.lit("</td></tr></tbody></table>")))
              .when(k == 2, F.concat(F.lit('<meta charset="utf-8">'), left))
              .when(k == 3, F.concat(F.lit("\n<!--StartFragment--><table>\n  <tr><td>"), words,
                                     F.lit("</td></tr>\n</table><!--EndFragment-->")))
              .otherwise(F.concat(F.lit("<table><tr><td>"), words, F.lit(" changed</td></tr></table>"))))
    return d.select("doc_id", left.alias("left_html"), right.alias("right_html"))


def fx10_selections(spark: SparkSession, sf: str) -> DataFrame:
    """Selected text vs clipboard text: prefix / shifted / unrelated (every word x-prefixed) by ``doc_id % 3``; every
    fourth document comes from a table selection."""
    d = load_table(spark, sf, "documents", ["doc_id", "text"])
    k = F.col("doc_id") % 3
    sel = (F.when(k == 0, F.substring("text", 1, 80))
            .when(k == 1, F.substring("text", 40, 80))
            .otherwise(F.regexp_replace(F.substring("text", 1, 80), "(\\S+)", "x$1")))
    return d.select("doc_id", sel.alias("selected_text"), F.col("text").alias("clip_text"),
                    (F.col("doc_id") % 4 == 0).alias("is_table"))


def fx11_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Clipboard entries present or absent by ``doc_id % 4``: both / plain only / html only / none."""
    d = load_table(spark, sf, "documents", ["doc_id", "text", "source"])
    k = F.col("doc_id") % 4
    html = F.concat(F.lit("<p>"), F.col("source"), F.lit("</p>"))
    return d.select("doc_id",
                    F.when(k.isin(0, 1), F.col("source")).alias("plain"),
                    F.when(k.isin(0, 2), html).alias("html"))


def fx12_base64(spark: SparkSession, sf: str) -> DataFrame:
    """Inline base64 image per part (``p_name`` encoded as the image bytes)."""
    p = load_table(spark, sf, "part", ["p_partkey", "p_name"])
    html = F.concat(F.lit('<p>'), F.col("p_name"), F.lit('<img src="data:image/png;base64,'),
                    F.base64(F.col("p_name").cast("binary")), F.lit('"></p>'))
    return p.select(F.col("p_partkey").alias("doc_id"), html.alias("html"))


def fx12_oversize(spark: SparkSession, sf: str, dealt: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Plain payloads per document; every 25th document repeated 200 times to cross the size guard. ``dealt`` moves the
    documents before they are repeated."""
    d = dealt(load_table(spark, sf, "documents", ["doc_id", "text"]))
    plain = F.when(F.col("doc_id") % 25 == 0, F.repeat(F.col("text"), 200)).otherwise(F.col("text"))
    return d.select("doc_id", plain.alias("plain"))


# ---------------------------------------------------------------------------------------------------------------
# DuckDB twins (subqueries over the pre-registered views).

def _fx1():
    return """(SELECT CAST(s_suppkey // 10 AS BIGINT) AS doc_id,
  '<table style="border: 1px solid"><thead><tr><th>key</th><th>name</th></tr></thead><tbody>' ||
  string_agg('<tr><td>' || s_suppkey || '</td><td><div>' || s_name || '</div><div>r' || s_nationkey
             || '</div></td></tr>', '' ORDER BY s_suppkey) || '</tbody></table>' AS html
  FROM supplier GROUP BY s_suppkey // 10)"""


def _fx2():
    return """(SELECT CAST(s_suppkey // 10 AS BIGINT) AS doc_id,
  '<table>' || string_agg('<tr><td>' || s_suppkey || '</td><td>' || s_name || '</td></tr>', '' ORDER BY s_suppkey)
  || '</table>' AS html FROM supplier GROUP BY s_suppkey // 10)"""


def _fx3():
    sel = "CASE WHEN s_suppkey % 3 = 0 THEN ' aria-selected=\"true\"' ELSE '' END"
    return f"""(SELECT CAST(s_nationkey * 1000000 + s_suppkey // 200 AS BIGINT) AS doc_id,
  '<p>Suppliers of group ' || CAST(s_nationkey * 1000000 + s_suppkey // 200 AS VARCHAR) || '</p><div role="grid">' ||
  '<div role="row"><span role="columnheader" data-col="0">key</span><span role="columnheader" data-col="1">name</span></div>' ||
  string_agg('<div role="row" data-row="' || s_suppkey || '"><span role="gridcell" data-row="' || s_suppkey ||
             '" data-col="0"' || {sel} || '>' || s_suppkey || '</span><span role="gridcell" data-row="' || s_suppkey ||
             '" data-col="1"' || {sel} || '>' || s_name || '</span></div>', '' ORDER BY s_suppkey) || '</div>' AS html
  FROM supplier GROUP BY s_nationkey * 1000000 + s_suppkey // 200)"""


def _fx4():
    return """(SELECT CAST(s_nationkey * 1000000 + s_suppkey // 200 AS BIGINT) AS doc_id,
  'key' || chr(9) || 'name' || chr(9) || 'flag' || chr(10) ||
  string_agg(s_suppkey || chr(9) || s_name ||
             CASE s_suppkey % 3 WHEN 1 THEN chr(9) || 'X' WHEN 2 THEN chr(9) || 'X' || chr(9) || 'extra' ELSE '' END
             || chr(10), '' ORDER BY s_suppkey) AS plain
  FROM supplier GROUP BY s_nationkey * 1000000 + s_suppkey // 200)"""


def _fx5():
    img = """'<img src="https://img.example/' || p_partkey || '.png"' ||
  CASE p_size % 5 WHEN 0 THEN ' width="1" height="1"' WHEN 1 THEN ' style="display: none"'
       WHEN 2 THEN ' style="width: ' || p_size || '.5px; height: 10px"' WHEN 3 THEN ' alt="' || p_brand || '"'
       ELSE '' END || '>'"""
    return f"""(SELECT p_partkey AS doc_id, '<p>' || p_name ||
  CASE WHEN p_size % 7 = 0 THEN '<a href="https://shop.example/' || p_partkey || '"> ' || {img} || ' </a>' ELSE {img} END
  || '</p>' AS html FROM part)"""


def _fx6():
    return """(SELECT p_partkey AS doc_id,
  CASE p_size % 4 WHEN 0 THEN 'color: red !important; padding: 2px'
       WHEN 1 THEN 'color: red; background-image: url(https://t.example/' || p_partkey || '.png); padding: 2px'
       WHEN 2 THEN '--accent: blue; color: red; padding: 2px'
       ELSE 'position: fixed; color: red; padding: 2px' END AS style FROM part)"""


def _fx7():
    return """(SELECT doc_id, '<div><div><div></div> <section> </section></div><div><div><p>' || lang ||
  '</p></div></div><a href="https://src.example/' || doc_id || '"><div>' || source || '</div>' || chr(10) || '<div>'
  || lang || '</div></a>' ||
  CASE WHEN doc_id % 2 = 0 THEN '<b style="font-weight:normal">Source ' || source || '</b>'
       ELSE '<a href="https://more.example/' || doc_id || '" aria-label="See more from ' || source ||
            '"><svg><path d="M0 0"></path></svg></a>' END || '</div>' AS html FROM documents)"""


def _fx8():
    return """(SELECT CAST(k AS BIGINT) AS doc_id, 0 AS table_no, r, c, 'tbody' AS section, false AS is_header,
  text, r * 3 + c BETWEEN 1 AND 7 AS selected, 'native' AS strategy FROM (
  SELECT s_suppkey // 10 AS k, CAST(row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) - 1 AS INTEGER) AS r,
         unnest([CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR)]) AS text,
         CAST(unnest(range(3)) AS INTEGER) AS c
  FROM supplier))"""


def _fx9():
    words = "regexp_replace(text, '[<>&\\s]+', ' ', 'g')"
    return f"""(SELECT doc_id, '<table><tr><td>' || w || '</td></tr></table>' AS left_html,
  CASE doc_id % 5 WHEN 0 THEN '<table><tr><td>' || w || '</td></tr></table>'
       WHEN 1 THEN '<table><tbody><tr><td>' || w || '</td></tr></tbody></table>'
       WHEN 2 THEN '<meta charset="utf-8"><table><tr><td>' || w || '</td></tr></table>'
       WHEN 3 THEN chr(10) || '<!--StartFragment--><table>' || chr(10) || '  <tr><td>' || w || '</td></tr>' || chr(10)
                   || '</table><!--EndFragment-->'
       ELSE '<table><tr><td>' || w || ' changed</td></tr></table>' END AS right_html
  FROM (SELECT doc_id, {words} AS w FROM documents))"""


def _fx10():
    return """(SELECT doc_id,
  CASE doc_id % 3 WHEN 0 THEN substring(text, 1, 80) WHEN 1 THEN substring(text, 40, 80)
       ELSE regexp_replace(substring(text, 1, 80), '(\\S+)', 'x\\1', 'g') END AS selected_text, text AS clip_text, doc_id % 4 = 0 AS is_table
  FROM documents)"""


def _fx11():
    return """(SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN source END AS plain,
  CASE WHEN doc_id % 4 IN (0, 2) THEN '<p>' || source || '</p>' END AS html FROM documents)"""


def _fx12():
    return """(SELECT p_partkey AS doc_id, '<p>' || p_name || '<img src="data:image/png;base64,' ||
  to_base64(encode(p_name)) || '"></p>' AS html FROM part)"""


def _fx12o():
    return """(SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN repeat(text, 200) ELSE text END AS plain FROM documents)"""


DUCK = {"fx1": _fx1(), "fx2": _fx2(), "fx3": _fx3(), "fx4": _fx4(), "fx5": _fx5(), "fx6": _fx6(), "fx7": _fx7(),
        "fx8": _fx8(), "fx9": _fx9(), "fx10": _fx10(), "fx11": _fx11(), "fx12": _fx12(), "fx12o": _fx12o()}


def fx13_code(spark: SparkSession, sf: str) -> DataFrame:
    """Code payload per document: a fenced block holding the first line of the text, a backtick run opening a line
    (none / 3 / 5 by ``doc_id % 3``) and the whole rest of the text; then inline code."""
    d = load_table(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first = F.substring_index(text, "\n", 1)
    rest = F.substr(text, F.length(first) + 2)
    k = F.col("doc_id") % 3
    tick = F.when(k == 0, F.lit("```\n")).when(k == 1, F.lit("`````x\n")).otherwise(F.lit(""))
    html = F.concat(F.lit("<p>"), F.col("source"), F.lit(" snippet</p><pre><code>"), first, F.lit("\n"), tick, rest,
                    F.lit("\n</code></pre><p>call <code>"), F.col("lang"), F.lit("</code> now</p>"))
    return d.select("doc_id", html.alias("html"))


def _fx13():
    return """(SELECT doc_id, '<p>' || source || ' snippet</p><pre><code>' || string_split(t, chr(10))[1] || chr(10) ||
  CASE doc_id % 3 WHEN 0 THEN '```' || chr(10) WHEN 1 THEN '`````x' || chr(10) ELSE '' END ||
  array_to_string(string_split(t, chr(10))[2:], chr(10)) || chr(10) ||
  '</code></pre><p>call <code>' || lang || '</code> now</p>' AS html
  FROM (SELECT *, replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;') AS t FROM documents))"""


DUCK["fx13"] = _fx13()
