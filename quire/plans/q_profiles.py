"""Rendering profiles (D5): styled / unstyled preview of payloads carrying inline styles (FX6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import style as ST
from ..operators.nodes import ordered_concat, to_nodes, with_spans
from ..operators.policy import apply_render_profile
from ..operators.render_html import token_html
from . import duck as D
from . import fixtures as X
from .q_payloads import d_style_verdict
from .registry import query


def styled_payloads(spark, sf):
    s = X.fx6_styles(spark, sf)
    html = F.concat(F.lit('<p class="c" id="p'), F.col("doc_id").cast("string"), F.lit('" data-k="1" onclick="go()" '
                    'style="'), F.col("style"), F.lit('">part '), F.col("doc_id").cast("string"), F.lit("</p>"))
    return s.select("doc_id", html.alias("html"))


def d_styled_payloads():
    return (f"(SELECT doc_id, '<p class=\"c\" id=\"p' || doc_id || '\" data-k=\"1\" onclick=\"go()\" style=\"' || style "
            f"|| '\">part ' || doc_id || '</p>' AS html FROM {X.DUCK['fx6']})")


def _d_rebuild(v):
    parsed = (f"list_transform(list_filter(string_split(coalesce({v}, ''), ';'), lambda d: trim(d) <> ''), lambda d: "
              f"{{'prop': lower(trim(regexp_extract(d, '^([^:]*)', 1))), "
              f"'value': trim(regexp_replace(trim(regexp_extract(d, '(?s)^[^:]*:(.*)$', 1)), '(?i)\\s*!\\s*important$', '', 'g')), "
              f"'important': regexp_matches(trim(regexp_extract(d, '(?s)^[^:]*:(.*)$', 1)), '(?i)!\\s*important$')}})")
    kept = f"list_filter({parsed}, lambda x: ({d_style_verdict('x.prop', 'x.value')}) IS NULL)"
    return (f"array_to_string(list_transform({kept}, lambda x: x.prop || ': ' || x.value || "
            f"CASE WHEN x.important THEN ' !important' ELSE '' END), '; ')")


def _d_profiles():
    nodes, _ = D.nodes_ctes("src", "n")
    base = "NOT (e.k IN ('class', 'id') OR starts_with(e.k, 'data-') OR starts_with(e.k, 'on'))"
    styled = (f"list_filter(list_transform(list_filter(attrs, lambda e: {base}), lambda e: {{'k': e.k, 'v': "
              f"CASE WHEN e.k = 'style' THEN {_d_rebuild('e.v')} ELSE e.v END}}), lambda e: e.k <> 'style' OR e.v <> '')")
    unstyled = f"list_filter(attrs, lambda e: {base} AND e.k <> 'style')"
    return f"""WITH src AS {d_styled_payloads()},{nodes},
pr AS (SELECT *, CASE WHEN attrs IS NOT NULL THEN {styled} END AS a_styled,
              CASE WHEN attrs IS NOT NULL THEN {unstyled} END AS a_plain FROM n_spans)
SELECT doc_id, string_agg({D.token_html(attrs='a_styled')}, '' ORDER BY pos) AS styled_html,
       string_agg({D.token_html(attrs='a_plain')}, '' ORDER BY pos) AS unstyled_html
FROM pr GROUP BY doc_id"""


@query("d5_render_profiles", oracle=_d_profiles)
def d5_render_profiles(spark, sf):
    """Each payload rendered under the styled profile (allowed inline declarations kept) and the
    unstyled one; class, id, data-* and handlers dropped. Both serializations come from one aggregate."""
    n = with_spans(to_nodes(styled_payloads(spark, sf)))
    styled = apply_render_profile(n, True).withColumnRenamed("attrs", "a_styled")
    both = apply_render_profile(styled.withColumnRenamed("a_styled", "attrs").withColumn("a_styled", F.col("attrs")),
                                False)
    k, t, x, m = F.col("kind"), F.col("tag"), F.col("text"), F.col("matched")
    return both.groupBy("doc_id").agg(
        ordered_concat(F.col("pos"), token_html(k, t, F.col("a_styled"), x, m)).alias("styled_html"),
        ordered_concat(F.col("pos"), token_html(k, t, F.col("attrs"), x, m)).alias("unstyled_html"))
