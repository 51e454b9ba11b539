"""Node-relation queries over ``pages`` and the HTML fixtures: C1-C3, C6, C7, D1, D3, D4, F10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.nodes import subtree_text, to_nodes, with_spans, with_tree
from ..operators.policy import (ALLOWED_ATTR, ALLOWED_TAGS, BLOCK_TAGS, GRID_ALLOWED_TAGS, policy_table, sanitize,
                               with_policy)
from ..operators.render_html import to_html
from . import duck as D
from . import fixtures as X
from .q_markdown import pages_payloads, pages_src
from .registry import query

Q = D.q


def page_nodes(spark, sf):
    return to_nodes(pages_payloads(spark, sf))


def _pages_nodes_sql(select: str, allowed=None, attr_allow=None, src=None) -> str:
    nodes, tree = D.nodes_ctes("src", "n", allowed, attr_allow)
    return f"WITH src AS {src or pages_src()},{nodes}\n{select.format(tree=tree)}"


# ---------------------------------------------------------------------------------------------------------------
# C1-C3, C7

@query("c1_tokens", oracle=lambda: _pages_nodes_sql("""
SELECT doc_id AS page_id, count(*) AS n_tokens, count(*) FILTER (WHERE kind = 'open') AS n_open,
  count(*) FILTER (WHERE kind = 'close') AS n_close, count(*) FILTER (WHERE kind = 'void') AS n_void,
  count(*) FILTER (WHERE kind = 'text') AS n_text
FROM n_nodes GROUP BY doc_id"""))
def c1_tokens(spark, sf):
    """Token counts per page by kind."""
    n = page_nodes(spark, sf)
    k = F.col("kind")
    return n.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.count(F.lit(1)).alias("n_tokens"), *[F.count(F.when(k == x, 1)).alias(f"n_{x}")
                                              for x in ("open", "close", "void", "text")])


@query("c2_spans", oracle=lambda: _pages_nodes_sql("""
SELECT doc_id AS page_id, tag, count(*) FILTER (WHERE kind = 'open') AS n_open,
  count(*) FILTER (WHERE kind = 'open' AND matched) AS n_matched,
  count(*) FILTER (WHERE kind = 'open' AND NOT matched) AS n_unclosed,
  count(*) FILTER (WHERE kind = 'close' AND NOT matched) AS n_stray_close,
  CAST(sum(CASE WHEN kind = 'open' AND matched THEN end_pos - pos ELSE 0 END) AS BIGINT) AS span_tokens
FROM n_spans WHERE kind IN ('open', 'close') GROUP BY doc_id, tag"""))
def c2_spans(spark, sf):
    """Per page and tag, openers matched to closers, unclosed openers, stray closers, span widths."""
    s = with_spans(page_nodes(spark, sf)).filter(F.col("kind").isin("open", "close"))
    k, m = F.col("kind"), F.col("matched")
    return s.groupBy(F.col("doc_id").alias("page_id"), "tag").agg(
        F.count(F.when(k == "open", 1)).alias("n_open"),
        F.count(F.when((k == "open") & m, 1)).alias("n_matched"),
        F.count(F.when((k == "open") & ~m, 1)).alias("n_unclosed"),
        F.count(F.when((k == "close") & ~m, 1)).alias("n_stray_close"),
        F.sum(F.when((k == "open") & m, F.col("end_pos") - F.col("pos")).otherwise(0)).cast("bigint")
         .alias("span_tokens"))


@query("c3_tree", oracle=lambda: _pages_nodes_sql("""
SELECT doc_id AS page_id, max(depth) AS max_depth,
  count(*) FILTER (WHERE kind IN ('open', 'void', 'text') AND parent_pos IS NULL) AS n_top_level,
  count(DISTINCT parent_pos) AS n_parents,
  count(*) FILTER (WHERE parent_tag = 'li') AS n_in_li
FROM {tree} GROUP BY doc_id"""))
def c3_tree(spark, sf):
    """Depth and parent per token; per page the deepest level, top-level nodes, distinct parents."""
    t = with_tree(with_spans(page_nodes(spark, sf)))
    return t.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max("depth").alias("max_depth"),
        F.count(F.when(F.col("kind").isin("open", "void", "text") & F.col("parent_pos").isNull(), 1))
         .alias("n_top_level"),
        F.countDistinct("parent_pos").alias("n_parents"),
        F.count(F.when(F.col("parent_tag") == "li", 1)).alias("n_in_li"))


@query("c7_subtree_text", oracle=lambda: _pages_nodes_sql("""
SELECT e.doc_id AS page_id, e.pos, e.tag, coalesce(string_agg(t.text, '' ORDER BY t.pos), '') AS text
FROM (SELECT doc_id, pos, tag, end_pos FROM n_spans WHERE kind = 'open' AND matched AND tag IN ('h1', 'a', 'li')) e
LEFT JOIN (SELECT doc_id, pos, text FROM n_spans WHERE kind = 'text') t
  ON t.doc_id = e.doc_id AND t.pos > e.pos AND t.pos < e.end_pos
GROUP BY e.doc_id, e.pos, e.tag"""))
def c7_subtree_text(spark, sf):
    """textContent of every heading, link and list item (each text token credited to the elements around it)."""
    txt = subtree_text(with_spans(page_nodes(spark, sf)), F.col("tag").isin("h1", "a", "li"))
    return txt.select(F.col("doc_id").alias("page_id"), "pos", "tag", "text")


# ---------------------------------------------------------------------------------------------------------------
# D1, F10, D3, D4, C6

def _d_policy_action():
    return f"CASE WHEN tag IN {D.in_list(ALLOWED_TAGS)} THEN 'keep' ELSE 'unwrap' END"


@query("d1_tag_policy", oracle=lambda: _pages_nodes_sql(f"""
SELECT doc_id AS page_id, {_d_policy_action()} AS action, count(*) AS n_tokens
FROM n_nodes WHERE kind <> 'text' GROUP BY doc_id, {_d_policy_action()}"""))
def d1_tag_policy(spark, sf):
    """Element tokens each page keeps or unwraps under the default profile (broadcast policy join)."""
    n = with_policy(page_nodes(spark, sf).filter(F.col("kind") != "text"), policy_table(spark))
    return n.groupBy(F.col("doc_id").alias("page_id"), F.coalesce("action", F.lit("unwrap")).alias("action")) \
            .agg(F.count(F.lit(1)).alias("n_tokens"))


@query("f10_policy_lookup", oracle=lambda: _pages_nodes_sql(f"""
SELECT tag, {_d_policy_action()} AS action,
  tag IN {D.in_list(BLOCK_TAGS)} AS is_block,
  count(*) AS n_tokens, count(DISTINCT doc_id) AS n_pages
FROM n_nodes WHERE kind <> 'text' GROUP BY tag"""))
def f10_policy_lookup(spark, sf):
    """corpus-wide element counts joined to the policy dimension (action, block flag)."""
    n = with_policy(page_nodes(spark, sf).filter(F.col("kind") != "text"), policy_table(spark))
    return n.groupBy("tag").agg(
        F.first(F.coalesce("action", F.lit("unwrap"))).alias("action"),
        F.first(F.coalesce("is_block", F.lit(False))).alias("is_block"),
        F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("doc_id").alias("n_pages"))


def _fx_html_union(spark, sf):
    return (X.fx7_cards(spark, sf).select(F.lit("fx7").alias("src"), "doc_id", "html")
            .unionByName(X.fx5_images(spark, sf).select(F.lit("fx5").alias("src"), "doc_id", "html")))


@query("d3_attr_policy", oracle=lambda: f"""
WITH src AS (SELECT doc_id * 10 + (CASE WHEN s = 'fx7' THEN 7 ELSE 5 END) AS doc_id, s, html FROM (
  SELECT 'fx7' AS s, doc_id, html FROM {X.DUCK['fx7']} UNION ALL SELECT 'fx5', doc_id, html FROM {X.DUCK['fx5']})),
{D.nodes_ctes('src', 'n', ALLOWED_TAGS, ALLOWED_ATTR)[0]}
SELECT doc_id, pos, tag, coalesce(array_to_string(list_transform(attrs, lambda e: e.k || '=' || e.v), ';'), '') AS kept
FROM n_nodes WHERE kind IN ('open', 'void') AND len(attrs) > 0""")
def d3_attr_policy(spark, sf):
    """D3: attributes that survive the allowlist (``aria-*`` kept, ``data-*``, ``style``, ``class`` dropped)."""
    src = _fx_html_union(spark, sf).select(
        (F.col("doc_id") * 10 + F.when(F.col("src") == "fx7", 7).otherwise(5)).alias("doc_id"), "html")
    n = sanitize(to_nodes(src)).filter(F.col("kind").isin("open", "void") & (F.size("attrs") > 0))
    kept = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                        ";")
    return n.select("doc_id", "pos", "tag", kept.alias("kept"))


@query("c6_serialize", oracle=lambda: _pages_nodes_sql(
    f"SELECT doc_id AS page_id, html FROM {D.html_sql('{tree}', 'src')}", ALLOWED_TAGS, ALLOWED_ATTR))
def c6_serialize(spark, sf):
    """C6 after D1+D3: each page as sanitized HTML (allowlisted tags and attributes, re-spelled, escaped)."""
    p = pages_payloads(spark, sf)
    t = with_spans(sanitize(to_nodes(p, doc_marker=True)))
    return to_html(t).withColumnRenamed("doc_id", "page_id")


@query("d4_grid_profile", oracle=lambda: _pages_nodes_sql(
    f"SELECT doc_id, html FROM {D.html_sql('{tree}', 'src')}", GRID_ALLOWED_TAGS, [], src=X.DUCK["fx1"]))
def d4_grid_profile(spark, sf):
    """Native tables under the strict grid profile (six tags, no attributes)."""
    p = X.fx1_native_tables(spark, sf)
    t = with_spans(sanitize(to_nodes(p, doc_marker=True), "grid"))
    return to_html(t)
