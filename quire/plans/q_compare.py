"""Canonical comparison of payloads (D15, F8, K25 entry equality) over FX9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.compare import CANONICAL_DROP_TAGS, CANONICAL_UNWRAP_TAGS, TABLE_STRUCTURE, canonical_html, same_entry
from . import duck as D
from . import duck_repair as R
from . import fixtures as X
from .registry import query


def d_canonical(src_sql: str) -> str:
    nodes, _ = D.nodes_ctes("src", "n")
    drop = D.in_list(CANONICAL_DROP_TAGS + CANONICAL_UNWRAP_TAGS)
    c = R.Chain("cz0")
    c.spans().tree()
    ws = f"({R.blank()} AND coalesce(parent_tag IN {D.in_list(TABLE_STRUCTURE)}, false))"
    c.step(lambda inp, p: (f"\n{p}_out AS (SELECT * FROM {inp} WHERE NOT {ws})", f"{p}_out"))
    out = D.html_sql(c.cur, "src", "canonical")
    return (f"WITH src AS {src_sql},{nodes},\ncz0 AS (SELECT * FROM n_nodes WHERE NOT coalesce(tag IN {drop}, false)),"
            f"{c.sql()},\ncanon AS (SELECT doc_id, trim(regexp_replace(canonical, '^\\s+|\\s+$', '', 'g')) AS canonical "
            f"FROM {out})")


@query("d15_canonical", oracle=lambda: d_canonical(
    f"(SELECT doc_id, right_html AS html FROM {X.DUCK['fx9']})") + "\nSELECT doc_id, canonical FROM canon")
def d15_canonical(spark, sf):
    """Canonical form of every respelled payload (meta, comments, tbody, table whitespace absorbed)."""
    p = X.fx9_pairs(spark, sf).select("doc_id", F.col("right_html").alias("html"))
    return canonical_html(p)


@query("f8_same_entry", oracle=lambda: d_canonical(
    f"(SELECT doc_id * 2 AS doc_id, left_html AS html FROM {X.DUCK['fx9']} UNION ALL "
    f"SELECT doc_id * 2 + 1, right_html FROM {X.DUCK['fx9']})")
    + "\nSELECT doc_id // 2 AS doc_id, count(DISTINCT sha256(canonical)) = 1 AS same FROM canon GROUP BY doc_id // 2")
def f8_same_entry(spark, sf):
    """F8: pairs that are the same clipboard entry once transport artefacts are absorbed."""
    return same_entry(X.fx9_pairs(spark, sf))
