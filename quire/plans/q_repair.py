"""Repair, naming, collapse and Simple HTML queries over the HTML fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive as DV
from ..operators.render_html import to_html
from ..operators.repair import beacon_reason
from ..operators.nodes import to_nodes
from . import duck as D
from . import duck_repair as R
from . import fixtures as X
from .registry import query

FX_CODES = {"fx1": 1, "fx2": 2, "fx5": 5, "fx7": 7}
BUILDERS = {"fx1": X.fx1_native_tables, "fx2": X.fx2_headerless_tables, "fx5": X.fx5_images, "fx7": X.fx7_cards}


def fx_union(spark, sf, names):
    """Several HTML fixtures as one payload set; ``doc_id`` made unique as ``doc_id * 10 + code``."""
    out = None
    for n in names:
        df = BUILDERS[n](spark, sf).select((F.col("doc_id") * 10 + FX_CODES[n]).alias("doc_id"), "html")
        out = df if out is None else out.unionByName(df)
    return out


def d_fx_union(names):
    return "(" + " UNION ALL ".join(
        f"SELECT doc_id * 10 + {FX_CODES[n]} AS doc_id, html FROM {X.DUCK[n]}" for n in names) + ")"


ORDER = ["e1", "d10", "d9", "e2", "sanitize", "e7", "d11", "d12", "d13", "e6"]


def d_chain(src_sql: str, upto: str, col: str = "html", blank_empty: bool = False) -> str:
    nodes, _ = D.nodes_ctes("src", "n")
    c = R.Chain("n_src0")
    c.spans().tree().step(R.e1).spans()
    steps = [("d10", lambda: c.step(R.d10)), ("d9", lambda: c.step(R.d8d9)), ("e2", lambda: c.step(R.e2)),
             ("sanitize", lambda: c.step(R.sanitize)), ("e7", lambda: c.step(R.e7)), ("d11", lambda: c.step(R.d11)),
             ("d12", lambda: c.tree().step(R.d12)), ("d13", lambda: c.step(R.d13)),
             ("e6", lambda: c.respan().tree().step(R.e6))]
    if upto != "e1":
        for name, fn in steps:
            fn()
            if name == upto:
                break
    out = R.html(c.cur, "src", col)
    sel = f"SELECT doc_id, {col} FROM {out}"
    if blank_empty:
        sel = (f"SELECT doc_id, CASE WHEN trim(regexp_replace({col}, '\\s', ' ', 'g')) = '' THEN '' ELSE {col} END "
               f"AS {col} FROM {out}")
    return (f"WITH src AS {src_sql},{nodes},\nn_src0 AS (SELECT *, CAST(NULL AS VARCHAR) AS before FROM n_nodes),"
            f"{c.sql()}\n{sel}")


def _spark_stage(payloads, upto, col="html"):
    if upto in ("e1", "d10", "d9", "e2"):
        return to_html(DV.repaired(payloads, upto=upto), out_col=col)
    return to_html(DV.simple_html_nodes(payloads, upto=upto), out_col=col)


def _stage_query(name, fixtures, upto, doc):
    def run(spark, sf):
        return _spark_stage(fx_union(spark, sf, fixtures), upto)
    run.__doc__ = doc
    query(name, oracle=lambda: d_chain(d_fx_union(fixtures), upto))(run)
    return run


e1_cell_divs = _stage_query("e1_cell_divs", ["fx1"], "e1", "E1: cell divs inlined, <br> between content.")
d10_fake_bold = _stage_query("d10_fake_bold", ["fx7"], "d10", "D10: fake bold wrappers unwrapped.")
d9_emptied_links = _stage_query("d9_emptied_links", ["fx5"], "d9", "D8+D9: beacons and the anchors they emptied.")
e2_image_size = _stage_query("e2_image_size", ["fx5"], "e2", "E2: style pixel sizes transcribed to attributes.")
e7_names = _stage_query("e7_names", ["fx7", "fx5"], "e7", "E7: empty links and unnamed images named.")
d11_empty_containers = _stage_query("d11_empty_containers", ["fx7"], "d11", "D11: empty containers removed.")
d12_unwrap = _stage_query("d12_unwrap", ["fx7"], "d12", "D12: one-child wrapper divs unwrapped.")
d13_dead_ws = _stage_query("d13_dead_ws", ["fx7"], "d13", "D13: whitespace touching blocks removed.")
e6_simplify = _stage_query("e6_simplify", ["fx2", "fx1"], "e6", "E6: headerless tables lose tbody; tidy.")


@query("b5_simple_html", oracle=lambda: d_chain(d_fx_union(["fx1", "fx2", "fx5", "fx7"]), "e6", "simple_html",
                                                 blank_empty=True))
def b5_simple_html(spark, sf):
    """The Simple HTML equivalent of every HTML fixture ('' when nothing is left)."""
    return DV.to_simple_html(fx_union(spark, sf, ["fx1", "fx2", "fx5", "fx7"]))


@query("d8_beacons", oracle=lambda: f"""
WITH src AS {X.DUCK['fx5']},{D.nodes_ctes('src', 'n')[0]}
SELECT doc_id, pos, {R.beacon_reason('attrs')} AS reason FROM n_nodes
WHERE tag = 'img' AND kind = 'void' AND {R.beacon_reason('attrs')} IS NOT NULL""")
def d8_beacons(spark, sf):
    """Every image that is a beacon, with the rule that caught it."""
    n = to_nodes(X.fx5_images(spark, sf))
    img = n.filter((F.col("tag") == "img") & (F.col("kind") == "void"))
    return img.select("doc_id", "pos", beacon_reason(F.col("attrs")).alias("reason")).filter(F.col("reason").isNotNull())
