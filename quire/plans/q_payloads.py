"""Payload-level queries: guards, routing, TSV, style policy, staleness, sizes (A, B1/B2, D6/D7, D14, F7, G7,
G9, K20-K25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import style as ST
from ..functions import tsv as T
from ..functions.text import (BYTE_UNITS, JS_SPACE, MAX_PAYLOAD_CHARS, format_bytes, md_escape, normalize_text,
                              redact_base64, utf8_bytes)
from ..operators import compare as CMP
from ..operators import entries as EN
from ..operators import metrics as MET
from ..sources import payloads as P
from ..sources.tables import load_table
from . import duck as D
from . import fixtures as X
from .q_markdown import markdown_of, markdown_sql, pages_payloads, pages_src
from .registry import query

Q = D.q


# ---------------------------------------------------------------------------------------------------------------
# DuckDB restatements of the column functions

def d_js_trim(e):
    return f"regexp_replace({e}, {Q('^' + JS_SPACE + '+|' + JS_SPACE + '+$')}, '', 'g')"


def d_lines(e):
    return f"regexp_split_to_array({d_js_trim(e)}, {Q(T.LINE_SPLIT)})"


def d_is_tsv(html, plain):
    lines = d_lines(plain)
    return (f"(NOT coalesce({html} IS NOT NULL AND {html} <> '', false) AND {plain} IS NOT NULL AND {plain} <> '' "
            f"AND len({lines}) >= 2 AND len(string_split({lines}[1], chr(9))) > 1)")


def d_fit(line, n):
    return f"list_slice(list_concat(string_split({line}, chr(9)), repeat([''], {n})), 1, {n})"


def d_esc(e):
    return f"replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def d_format_bytes(b):
    i = f"CAST(least(floor(ln({b}) / ln(1024.0)), 4) AS INTEGER)"
    units = "[" + ", ".join(Q(u) for u in BYTE_UNITS) + "]"
    v = f"round({b} / pow(1024.0, {i}), 1)"
    return (f"CASE WHEN {b} IS NULL OR {b} <= 0 THEN '0 B' ELSE "
            f"regexp_replace(printf('%.1f', {v}), '\\.0$', '') || ' ' || {units}[{i} + 1] END")


# ---------------------------------------------------------------------------------------------------------------
# A6, A8, D14

@query("a6_quarantine_oversize", oracle=lambda: f"""
SELECT doc_id, length(plain) AS n_chars, NOT coalesce(length(plain) > {MAX_PAYLOAD_CHARS}, false) AS admitted
FROM {X.DUCK['fx12o']}""")
def a6_quarantine_oversize(spark, sf):
    df = X.fx12_oversize(spark, sf)
    ok, dead = P.quarantine_oversize(df, "plain")
    return (ok.withColumn("admitted", F.lit(True))
              .unionByName(dead.drop("reason").withColumn("admitted", F.lit(False)))
              .select("doc_id", F.length("plain").alias("n_chars"), "admitted"))


@query("a8_url_filter", oracle=lambda: f"""
SELECT page_id, url, coalesce(regexp_matches(url, {Q(P.ADMITTED_URL)}), false) AS admitted FROM pages""")
def a8_url_filter(spark, sf):
    p = load_table(spark, sf, "pages", ["page_id", "url"])
    return p.select("page_id", "url", P.admitted_url(F.col("url")).alias("admitted"))


@query("d14_redact_base64", oracle=lambda: f"""
SELECT doc_id, {D.rx('html', D.BASE64_IMAGE, D.BASE64_REPLACEMENT)} AS redacted FROM {X.DUCK['fx12']}""")
def d14_redact_base64(spark, sf):
    return X.fx12_base64(spark, sf).select("doc_id", redact_base64(F.col("html")).alias("redacted"))


# ---------------------------------------------------------------------------------------------------------------
# K24, K25, K11

@query("k24_format_bytes", oracle=lambda: f"""
SELECT doc_id, strlen(text) AS n_bytes, {d_format_bytes('strlen(text)')} AS size FROM documents""")
def k24_format_bytes(spark, sf):
    d = load_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", utf8_bytes(F.col("text")).alias("n_bytes"),
                    format_bytes(utf8_bytes(F.col("text"))).alias("size"))


@query("k25_normalize_text", oracle=lambda: f"""
SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\\r\\n', chr(10), 'g'), '\\s+$', '', 'g') AS normalized
FROM conversations""")
def k25_normalize_text(spark, sf):
    c = load_table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", normalize_text(F.col("text")).alias("normalized"))


@query("k11_escape", oracle=lambda: f"""
SELECT conv_id, turn, {D.md_escape('text')} AS escaped FROM conversations""")
def k11_escape(spark, sf):
    c = load_table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", md_escape(F.col("text")).alias("escaped"))


# ---------------------------------------------------------------------------------------------------------------
# TSV: G9, K20-K23

@query("g9_first_line_tabs", oracle=lambda: f"""
SELECT doc_id, len(string_split({d_lines('plain')}[1], chr(9))) - 1 AS tabs FROM {X.DUCK['fx4']}""")
def g9_first_line_tabs(spark, sf):
    return X.fx4_tsv(spark, sf).select("doc_id", T.first_line_tabs(F.col("plain")).alias("tabs"))


def _plain_payloads(spark, sf) -> DataFrame:
    """FX4 TSV texts, every document text, and FX11 entries (with and without html), tagged by source."""
    fx4 = X.fx4_tsv(spark, sf).select(F.lit("fx4").alias("src"), "doc_id", F.lit(None).cast("string").alias("html"),
                                      "plain")
    docs = load_table(spark, sf, "documents", ["doc_id", "text"]).select(
        F.lit("documents").alias("src"), "doc_id", F.lit(None).cast("string").alias("html"), F.col("text").alias("plain"))
    fx11 = X.fx11_entries(spark, sf).select(F.lit("fx11").alias("src"), "doc_id", "html", "plain")
    return fx4.unionByName(docs).unionByName(fx11)


def _d_plain_payloads():
    return (f"(SELECT 'fx4' AS src, doc_id, CAST(NULL AS VARCHAR) AS html, plain FROM {X.DUCK['fx4']} "
            f"UNION ALL SELECT 'documents', doc_id, CAST(NULL AS VARCHAR), text FROM documents "
            f"UNION ALL SELECT 'fx11', doc_id, html, plain FROM {X.DUCK['fx11']})")


@query("k20_is_tsv", oracle=lambda: f"""
SELECT src, doc_id, {d_is_tsv('html', 'plain')} AS is_tsv FROM {_d_plain_payloads()}""")
def k20_is_tsv(spark, sf):
    return _plain_payloads(spark, sf).select("src", "doc_id", T.is_tsv(F.col("html"), F.col("plain")).alias("is_tsv"))


def _d_tsv_md():
    lines, n = "lines", "len(string_split(lines[1], chr(9)))"
    head = (f"'| ' || array_to_string(string_split(lines[1], chr(9)), ' | ') || ' |' || chr(10) || "
            f"'| ' || array_to_string(repeat(['---'], {n}), ' | ') || ' |' || chr(10)")
    rows = (f"array_to_string(list_transform(list_slice(lines, 2, len(lines)), lambda r: '| ' || "
            f"array_to_string({d_fit('r', n)}, ' | ') || ' |' || chr(10)), '')")
    return f"""SELECT doc_id, {head} || {rows} AS markdown
FROM (SELECT doc_id, {d_lines('plain')} AS lines FROM {X.DUCK['fx4']})"""


@query("k21_tsv_markdown", oracle=_d_tsv_md)
def k21_tsv_markdown(spark, sf):
    return X.fx4_tsv(spark, sf).select("doc_id", T.tsv_to_markdown(F.col("plain")).alias("markdown"))


def _d_tsv_html():
    n = "len(string_split(lines[1], chr(9)))"
    ths = (f"array_to_string(list_transform(string_split(lines[1], chr(9)), lambda c: {Q(T.TSV_HEADER_CELL)} || "
           f"{d_esc('c')} || '</th>' || chr(10)), '')")
    rows = (f"array_to_string(list_transform(list_slice(lines, 2, len(lines)), lambda r: '<tr>' || chr(10) || "
            f"array_to_string(list_transform({d_fit('r', n)}, lambda c: '<td>' || {d_esc('c')} || '</td>' || chr(10)), '')"
            f" || '</tr>' || chr(10)), '')")
    nl = "chr(10)"
    return f"""SELECT doc_id, '<table>' || {nl} || '<thead>' || {nl} || '<tr>' || {nl} || {ths} || '</tr>' || {nl} ||
  '</thead>' || {nl} || '<tbody>' || {nl} || {rows} || '</tbody>' || {nl} || '</table>' || {nl} AS simple_html
FROM (SELECT doc_id, {d_lines('plain')} AS lines FROM {X.DUCK['fx4']})"""


@query("k22_tsv_html", oracle=_d_tsv_html)
def k22_tsv_html(spark, sf):
    return X.fx4_tsv(spark, sf).select("doc_id", T.tsv_to_html(F.col("plain")).alias("simple_html"))


def tsv_cells(payloads: DataFrame, plain_col: str = "plain") -> DataFrame:
    """TSV text -> ``cells`` (header row r=0; rows padded / truncated to the header width)."""
    lines = T.tsv_lines(F.col(plain_col))
    n = F.size(F.split(F.element_at(lines, 1), "\t"))
    rows = payloads.select("doc_id", n.alias("_n"), F.posexplode(lines).alias("r", "_line"))
    cells = rows.select("doc_id", "r", F.posexplode(T._fit(F.col("_line"), F.col("_n"))).alias("c", "text"))
    return cells.select("doc_id", F.lit(0).alias("table_no"), F.col("r").cast("int").alias("r"),
                        F.col("c").cast("int").alias("c"), (F.col("r") == 0).alias("is_header"), "text")


@query("k23_tsv_cells", oracle=lambda: f"""
SELECT doc_id, 0 AS table_no, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, r = 0 AS is_header, text FROM (
  SELECT doc_id, r, unnest(cells) AS text, unnest(range(len(cells))) AS c FROM (
    SELECT doc_id, r, {d_fit('line', 'n')} AS cells FROM (
      SELECT doc_id, n, unnest(lines) AS line, unnest(range(len(lines))) AS r FROM (
        SELECT doc_id, lines, len(string_split(lines[1], chr(9))) AS n FROM (
          SELECT doc_id, {d_lines('plain')} AS lines FROM {X.DUCK['fx4']})))))""")
def k23_tsv_cells(spark, sf):
    return tsv_cells(X.fx4_tsv(spark, sf))


# ---------------------------------------------------------------------------------------------------------------
# B1 / B2 routing

@query("b1_route", oracle=lambda: f"""
SELECT src, doc_id, route,
  CASE route WHEN 'html' THEN {Q(EN.DERIVED_HTML)} WHEN 'tsv' THEN {Q(EN.DERIVED_PLAIN)} END AS derived_from,
  CASE route WHEN 'html' THEN {Q(EN.SOURCE_HTML)} WHEN 'tsv' THEN {Q(EN.SOURCE_TSV)} END AS source_type
FROM (SELECT src, doc_id,
        CASE WHEN html IS NOT NULL AND html <> '' THEN 'html' WHEN {d_is_tsv('html', 'plain')} THEN 'tsv'
             ELSE 'none' END AS route
      FROM {_d_plain_payloads()})""")
def b1_route(spark, sf):
    p = _plain_payloads(spark, sf).withColumn("route", EN.route(F.col("html"), F.col("plain")))
    r = F.col("route")
    return p.select("src", "doc_id", "route",
                    F.when(r == "html", F.lit(EN.DERIVED_HTML)).when(r == "tsv", F.lit(EN.DERIVED_PLAIN))
                     .alias("derived_from"),
                    F.when(r == "html", F.lit(EN.SOURCE_HTML)).when(r == "tsv", F.lit(EN.SOURCE_TSV))
                     .alias("source_type"))


@query("b2_hotkey_route", oracle=lambda: f"""
SELECT p.src, p.doc_id,
  CASE WHEN p.html IS NOT NULL AND p.html <> '' THEN 'html'
       WHEN g.doc_id IS NOT NULL THEN 'grid'
       WHEN {d_is_tsv('p.html', 'p.plain')} THEN 'tsv'
       WHEN p.plain IS NOT NULL AND p.plain <> '' THEN 'plain' ELSE 'none' END AS route
FROM {_d_plain_payloads()} p
LEFT JOIN (SELECT DISTINCT doc_id FROM {X.DUCK['fx8']}) g ON p.doc_id = g.doc_id""")
def b2_hotkey_route(spark, sf):
    p = EN.with_grid_flag(_plain_payloads(spark, sf), X.fx8_cells(spark, sf))
    return p.select("src", "doc_id", EN.hotkey_route(F.col("html"), F.col("plain"), F.col("has_grid")).alias("route"))


# ---------------------------------------------------------------------------------------------------------------
# D6 / D7 style policy

def _d_decls():
    raw = "trim(regexp_extract(decl, '(?s)^[^:]*:(.*)$', 1))"
    return f"""(SELECT doc_id, decl_no, prop, value, important FROM (
  SELECT doc_id, decl_no, lower(trim(regexp_extract(decl, '^([^:]*)', 1))) AS prop,
         trim(regexp_replace({raw}, '(?i)\\s*!\\s*important$', '', 'g')) AS value,
         regexp_matches({raw}, '(?i)!\\s*important$') AS important
  FROM (SELECT doc_id, unnest(string_split(style, ';')) AS decl, CAST(unnest(range(len(string_split(style, ';')))) AS INTEGER) AS decl_no
        FROM {X.DUCK['fx6']}) WHERE trim(decl) <> ''))"""


def d_style_verdict(prop, value):
    name = f"lower({prop})"
    return (f"CASE WHEN coalesce({prop}, '') = '' THEN 'empty' WHEN coalesce({value}, '') = '' THEN 'empty' "
            f"WHEN starts_with({name}, '--') THEN 'custom-property' "
            f"WHEN NOT regexp_matches({name}, {Q(ST.PROPERTY_NAME)}) THEN 'malformed-name' "
            f"WHEN regexp_matches({value}, {Q(ST.FETCHING_FUNCTION)}) THEN 'fetching-function' "
            f"WHEN regexp_matches({value}, {Q(ST.LEGACY_SCRIPTING)}) THEN 'legacy-scripting' "
            f"WHEN {name} = 'position' AND regexp_matches(trim({value}), {Q(ST.OUT_OF_FLOW)}) THEN 'out-of-flow' END")


@query("d6_style_audit", oracle=lambda: f"""
SELECT doc_id, decl_no, prop, value, important, reason, reason IS NULL AS allowed FROM (
  SELECT *, {d_style_verdict('prop', 'value')} AS reason FROM {_d_decls()})""")
def d6_style_audit(spark, sf):
    a = ST.style_audit(X.fx6_styles(spark, sf))
    return a.select("doc_id", F.col("decl_no").cast("int").alias("decl_no"), "prop", "value", "important", "reason",
                    "allowed")


@query("d7_style_rebuild", oracle=lambda: f"""
SELECT doc_id, coalesce(string_agg(CASE WHEN reason IS NULL THEN prop || ': ' || value ||
  CASE WHEN important THEN ' !important' ELSE '' END END, '; ' ORDER BY decl_no), '') AS style
FROM (SELECT *, {d_style_verdict('prop', 'value')} AS reason FROM {_d_decls()}) GROUP BY doc_id""")
def d7_style_rebuild(spark, sf):
    return ST.rebuild_style(ST.style_audit(X.fx6_styles(spark, sf)))


# ---------------------------------------------------------------------------------------------------------------
# F7 stale check

def _d_words(e):
    return f"list_filter(regexp_split_to_array({e}, {Q(JS_SPACE + '+')}), lambda w: length(w) > 0)"


@query("f7_stale_check", oracle=lambda: f"""
SELECT doc_id, checked, CASE WHEN checked THEN match_count END AS match_count,
       CASE WHEN checked THEN needed END AS needed,
       checked AND match_count < needed AND len(check_words) > 0 AS is_stale
FROM (SELECT doc_id, check_words, coalesce(selected_text <> '' AND clip_text <> '', false) AS checked,
        CASE WHEN is_table THEN 1 ELSE least(3, len(check_words)) END AS needed,
        len(list_filter(check_words, lambda w: list_contains(clip_words, w))) AS match_count
      FROM (SELECT doc_id, selected_text, clip_text, is_table,
              {_d_words('substring(selected_text, 1, 50)')} AS check_words,
              {_d_words('CASE WHEN is_table THEN clip_text ELSE substring(clip_text, 1, 100) END')} AS clip_words
            FROM {X.DUCK['fx10']}))""")
def f7_stale_check(spark, sf):
    f = X.fx10_selections(spark, sf)
    s = CMP.stale_check(F.col("selected_text"), F.col("clip_text"), F.col("is_table"))
    return f.select("doc_id", s.alias("s")).select("doc_id", "s.checked", "s.match_count", "s.needed", "s.is_stale")


# ---------------------------------------------------------------------------------------------------------------
# G7 payload metrics over the rendered pages

def _d_metrics():
    sb, db = "strlen(html)", "strlen(markdown)"
    ratio = f"CAST(round({sb} / {db}) AS BIGINT)"
    pct = f"CAST(round((1 - {db} / {sb}) * 100) AS BIGINT)"
    return markdown_sql(pages_src(), f"""SELECT s.doc_id AS page_id, {sb} AS source_bytes, {db} AS derived_bytes,
  {d_format_bytes(sb)} AS source_size, {d_format_bytes(db)} AS derived_size,
  CASE WHEN {db} > 0 AND {ratio} >= 10 THEN {ratio} END AS markup_ratio,
  CASE WHEN {sb} > 0 AND {pct} >= 1 THEN {pct} END AS savings_pct
FROM src s JOIN {{out}} m ON s.doc_id = m.doc_id""")


@query("g7_payload_metrics", oracle=_d_metrics)
def g7_payload_metrics(spark, sf):
    p = pages_payloads(spark, sf)
    md = markdown_of(p)
    # only the byte size of each payload crosses the join, never the HTML itself
    sizes = p.select("doc_id", utf8_bytes(F.col("html")).alias("html_bytes"))
    j = sizes.join(md, "doc_id")
    m = MET.payload_metrics(j, "html_bytes", "markdown", "markdown", source_is_bytes=True)
    return m.select(F.col("doc_id").alias("page_id"), "source_bytes", "derived_bytes", "source_size", "derived_size",
                    "markup_ratio", "savings_pct")
