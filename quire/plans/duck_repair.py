"""DuckDB restatement of the repair / naming / collapse / table-tidy steps (oracle side of
:mod:`quire.operators.repair`). Each generator takes an input relation name and a prefix and returns
``(ctes, output_name)``; spans and tree are re-derived with :func:`quire.plans.duck.spans_ctes` /
:func:`quire.plans.duck.tree_ctes` wherever the Spark side re-derives them."""

from __future__ import annotations

from ..functions.text import JS_SPACE
from ..operators import repair as RP
from ..operators.policy import ALLOWED_ATTR, ALLOWED_TAGS, BLOCK_TAGS, PLAIN_CONTAINERS
from .duck import RUN, attr, enclosing, esc_text, in_list, q, spans_ctes, token_html, tree_ctes

BASE = "doc_id, pos, kind, tag, text, attrs, before"
EMPTY_ATTRS = "CAST([] AS STRUCT(k VARCHAR, v VARCHAR)[])"
MO = "(kind = 'open' AND matched)"
MC = "(kind = 'close' AND matched)"
SK = "CASE WHEN kind = 'close' AND matched THEN open_pos ELSE pos END"


def js_trim(e):
    return f"regexp_replace({e}, {q('^' + JS_SPACE + '+|' + JS_SPACE + '+$')}, '', 'g')"


def blank():
    return f"(kind = 'text' AND {js_trim('coalesce(text, ' + q('') + ')')} = '')"


def nonblank_text():
    return f"(kind = 'text' AND NOT {blank()})"


def css(style, prop):
    return f"lower(trim(regexp_extract(coalesce({style}, ''), {q('(?i)(?:^|;)' + chr(92) + 's*' + prop + chr(92) + 's*:' + chr(92) + 's*([^;]*)')}, 1)))"


def vanishing(e):
    m = f"regexp_extract(trim(coalesce({e}, '')), {q(RP.VANISHING_LENGTH)}, 1)"
    return f"({m} <> '' AND CAST(nullif({m}, '') AS DOUBLE) <= 1)"


def set_attr(attrs, key, value):
    return (f"list_concat(list_transform({attrs}, lambda e: {{'k': e.k, 'v': CASE WHEN e.k = {q(key)} THEN {value} "
            f"ELSE e.v END}}), CASE WHEN NOT list_contains(list_transform({attrs}, lambda e: e.k), {q(key)}) "
            f"THEN [{{'k': {q(key)}, 'v': {value}}}] ELSE {EMPTY_ATTRS} END)")


def inside_counts(inp, p, flags: dict) -> tuple[str, str]:
    pref = ",\n    ".join(f"sum(CASE WHEN {f} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS _p_{n}"
                          for n, f in flags.items())
    at_close = ",\n    ".join(
        f"CASE WHEN {MC} THEN _p_{n} - (CASE WHEN {f} THEN 1 ELSE 0 END) - lag(_p_{n}) OVER w END AS _c_{n}"
        for n, f in flags.items())
    fin = ",\n    ".join(f"CASE WHEN {MO} OR {MC} THEN max(_c_{n}) OVER (PARTITION BY doc_id, _sk) END AS in_{n}"
                         for n in flags)
    drop = ", ".join(["_sk"] + [f"_p_{n}" for n in flags] + [f"_c_{n}" for n in flags])
    return f"""
{p}_ic1 AS (SELECT *, {pref}, {SK} AS _sk FROM {inp}),
{p}_ic2 AS (SELECT *, {at_close} FROM {p}_ic1 WINDOW w AS (PARTITION BY doc_id, _sk ORDER BY pos)),
{p}_ic AS (SELECT * EXCLUDE ({drop}), {fin} FROM {p}_ic2)""", f"{p}_ic"


def e1(inp_tree, p):
    cell = "tag IN ('td', 'th')"
    sib = f"(kind IN ('open', 'void') OR {nonblank_text()})"
    div_open = "(tag = 'div' AND _in_cell AND kind = 'open')"
    div_close = "(tag = 'div' AND _in_cell AND kind = 'close')"
    content_before = "coalesce(_prev.k = 'text' OR _prev.t <> 'br', false)"
    return f"""
{p}_1 AS (
  SELECT *, (sum(CASE WHEN {cell} AND {MO} THEN 1 WHEN {cell} AND {MC} THEN -1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY pos {RUN}) - CASE WHEN {cell} AND {MO} THEN 1 ELSE 0 END) > 0 AS _in_cell,
    last_value(CASE WHEN {sib} THEN {{'k': kind, 't': tag}} END IGNORE NULLS)
      OVER (PARTITION BY doc_id, parent_pos ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _prev
  FROM {inp_tree}
),
{p}_out AS (
  SELECT doc_id, pos, CASE WHEN {div_open} THEN 'void' ELSE kind END AS kind,
         CASE WHEN {div_open} THEN 'br' ELSE tag END AS tag, text,
         CASE WHEN {div_open} THEN {EMPTY_ATTRS} ELSE attrs END AS attrs, before
  FROM {p}_1 WHERE NOT (({div_open} AND NOT {content_before}) OR {div_close})
)""", f"{p}_out"


def fake(attrs):
    style = f"coalesce({attr(attrs, 'style')}, '')"
    return "(" + " OR ".join(f"instr({style}, {q(s)}) > 0" for s in RP.FAKE_BOLD_STYLES) + ")"


def d10(inp_spans, p):
    drop = f"(tag = 'b' AND ((kind = 'open' AND {fake('attrs')}) OR ({MC} AND {fake('opener_attrs')})))"
    return f"\n{p}_out AS (SELECT * FROM {inp_spans} WHERE NOT coalesce({drop}, false))", f"{p}_out"


def beacon_reason(attrs):
    style = attr(attrs, "style")
    return (f"CASE WHEN {css(style, 'display')} = 'none' THEN 'display:none' "
            f"WHEN {css(style, 'visibility')} = 'hidden' THEN 'visibility:hidden' "
            f"WHEN {vanishing(css(style, 'width'))} OR {vanishing(attr(attrs, 'width'))} THEN 'width<=1' "
            f"WHEN {vanishing(css(style, 'height'))} OR {vanishing(attr(attrs, 'height'))} THEN 'height<=1' END")


def d8d9(inp_spans, p):
    ic, ic_out = inside_counts(f"{p}_b", p, {"beacon": "_beacon", "el": "kind IN ('open', 'void') AND NOT _beacon",
                                             "txt": nonblank_text()})
    return f"""
{p}_b AS (SELECT *, coalesce(tag = 'img' AND kind = 'void' AND {beacon_reason('attrs')} IS NOT NULL, false) AS _beacon
          FROM {inp_spans}),{ic},
{p}_c AS (SELECT *, max(CASE WHEN {MO} AND tag = 'a' AND in_beacon > 0 AND in_el = 0 AND in_txt = 0 THEN end_pos END)
                      OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS _cover FROM {ic_out}),
{p}_out AS (SELECT * EXCLUDE (_beacon, in_beacon, in_el, in_txt, _cover) FROM {p}_c
            WHERE NOT _beacon AND NOT coalesce(pos <= _cover, false))""", f"{p}_out"


def pixel(style, axis):
    m = f"regexp_extract({css(style, axis)}, {q(RP.PIXEL_LENGTH)}, 1)"
    return f"CASE WHEN {m} <> '' THEN CAST(CAST(round(CAST(nullif({m}, '') AS DOUBLE)) AS BIGINT) AS VARCHAR) END"


def e2(inp, p):
    style = attr("attrs", "style")
    has_style = "len(list_filter(attrs, lambda e: e.k = 'style')) > 0"
    keys = "list_transform(attrs, lambda e: e.k)"
    new = (f"list_concat(list_transform(attrs, lambda e: {{'k': e.k, 'v': CASE WHEN e.k = 'width' AND _w IS NOT NULL "
           f"THEN _w WHEN e.k = 'height' AND _h IS NOT NULL THEN _h ELSE e.v END}}), "
           f"CASE WHEN _w IS NOT NULL AND NOT list_contains({keys}, 'width') THEN [{{'k': 'width', 'v': _w}}] "
           f"ELSE {EMPTY_ATTRS} END, CASE WHEN _h IS NOT NULL AND NOT list_contains({keys}, 'height') "
           f"THEN [{{'k': 'height', 'v': _h}}] ELSE {EMPTY_ATTRS} END)")
    img = f"(tag = 'img' AND kind = 'void' AND coalesce({has_style}, false))"
    return f"""
{p}_1 AS (SELECT *, CASE WHEN {img} THEN {pixel(style, 'width')} END AS _w,
                    CASE WHEN {img} THEN {pixel(style, 'height')} END AS _h FROM {inp}),
{p}_out AS (SELECT * EXCLUDE (_w, _h, attrs),
                   CASE WHEN {img} AND (_w IS NOT NULL OR _h IS NOT NULL) THEN {new} ELSE attrs END AS attrs
            FROM {p}_1)""", f"{p}_out"


def sanitize(inp, p, allowed=ALLOWED_TAGS, attr_allow=ALLOWED_ATTR):
    if attr_allow:
        keep = f"list_filter(attrs, lambda e: e.k IN {in_list(attr_allow)} OR starts_with(e.k, 'aria-'))"
    else:
        keep = "list_filter(attrs, lambda e: false)"
    return f"""
{p}_out AS (SELECT * EXCLUDE (attrs), CASE WHEN attrs IS NOT NULL THEN {keep} END AS attrs
            FROM {inp} WHERE kind = 'text' OR tag IN {in_list(allowed)})""", f"{p}_out"


def js_trim_end(e):
    return f"regexp_replace({e}, {q(JS_SPACE + '+$')}, '', 'g')"


def preview(name):
    return (f"CASE WHEN {name} IS NOT NULL THEN {js_trim_end(f'substring({name}, 1, {RP.NAME_PREVIEW_LENGTH})')} "
            f"|| {q(RP.ELLIPSIS)} ELSE {q(RP.UNNAMED)} END")


def element_name(attrs):
    parts = []
    for a in RP.NAME_ATTRIBUTES:
        v = js_trim(f"coalesce(list_filter({attrs}, lambda e: e.k = {q(a)})[1].v, '')")
        parts.append(f"CASE WHEN {v} <> '' THEN {v} END")
    return "coalesce(" + ", ".join(parts) + ")"


def e7(inp_spans, p):
    ic, ic_out = inside_counts(inp_spans, p, {"txt": nonblank_text(), "img": "tag = 'img'"})
    empty_a = "(tag = 'a' AND in_txt = 0 AND in_img = 0)"
    img_unnamed = f"(tag = 'img' AND kind = 'void' AND {js_trim(attr('attrs', 'alt'))} = '')"
    with_title = f"CASE WHEN _name IS NOT NULL THEN {set_attr('attrs', 'title', '_name')} ELSE attrs END"
    return f"""{ic},
{p}_1 AS (SELECT *, CASE WHEN {MO} AND {empty_a} THEN end_pos END AS _emp_end,
            max(CASE WHEN {MO} AND {empty_a} THEN end_pos END) OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS _cover
          FROM {ic_out}),
{p}_2 AS (SELECT *, CASE WHEN ({MO} AND {empty_a}) OR {img_unnamed} THEN {element_name('attrs')} END AS _name
          FROM {p}_1 WHERE NOT coalesce(pos < _cover AND NOT ({MO} AND {empty_a}), false)),
{p}_3 AS (SELECT * EXCLUDE (attrs),
            CASE WHEN {img_unnamed} THEN {set_attr(f'({with_title})', 'alt', preview('_name'))}
                 WHEN {MO} AND {empty_a} THEN {with_title} ELSE attrs END AS attrs,
            {SK} AS _sk FROM {p}_2),
{p}_4 AS (SELECT *, CASE WHEN {MC} AND tag = 'a' THEN lag({{'e': _emp_end IS NOT NULL, 'n': _name}})
                      OVER (PARTITION BY doc_id, _sk ORDER BY pos) END AS _op FROM {p}_3),
{p}_out AS (SELECT * EXCLUDE (before, opener_attrs, in_txt, in_img, _emp_end, _cover, _name, _sk, _op),
   CASE WHEN coalesce(_op.e, false) THEN coalesce(before, '') || {preview('_op.n')} ELSE before END AS before,
   CASE WHEN coalesce(_op.e, false) AND _op.n IS NOT NULL THEN {set_attr('opener_attrs', 'title', '_op.n')}
        ELSE opener_attrs END AS opener_attrs
   FROM {p}_4)""", f"{p}_out"


def d11(inp_spans, p):
    cont = f"tag IN {in_list(PLAIN_CONTAINERS)}"
    ic, ic_out = inside_counts(inp_spans, p, {"txt": f"({nonblank_text()} OR before IS NOT NULL)",
                                              "el": f"kind IN ('open', 'void') AND NOT coalesce({cont}, false)"})
    dead = f"({cont} AND {MO} AND in_txt = 0 AND in_el = 0)"
    return f"""{ic},
{p}_1 AS (SELECT *, max(CASE WHEN {dead} THEN end_pos END) OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS _cover
          FROM {ic_out}),
{p}_out AS (SELECT * EXCLUDE (in_txt, in_el, _cover) FROM {p}_1 WHERE NOT coalesce(pos <= _cover, false))""", \
        f"{p}_out"


def d12(inp_tree, p):
    child = f"(kind IN ('open', 'void') OR {nonblank_text()})"
    as_child = f"(_role = 0 AND {child})"
    return f"""
{p}_x AS (SELECT *, 0 AS _role, parent_pos AS _key FROM {inp_tree}
          UNION ALL SELECT *, 1 AS _role, pos AS _key FROM {inp_tree} WHERE {MO}),
{p}_1 AS (SELECT *, _role = 1 AND tag = 'div'
            AND sum(CASE WHEN {as_child} THEN 1 ELSE 0 END) OVER w = 1
            AND max(CASE WHEN {as_child} AND kind <> 'open' THEN 1 ELSE 0 END) OVER w = 0
            AND coalesce(max(CASE WHEN {as_child} AND kind = 'open' THEN tag END) OVER w
                         IN {in_list(PLAIN_CONTAINERS + ['figure'])}, false) AS _unwrap
          FROM {p}_x WINDOW w AS (PARTITION BY doc_id, _key)),
{p}_2 AS (SELECT *, max(CAST(_unwrap AS INTEGER)) OVER (PARTITION BY doc_id, {SK}) AS _u FROM {p}_1),
{p}_out AS (SELECT * EXCLUDE (_role, _key, _unwrap, _u) FROM {p}_2
            WHERE _role = 0 AND NOT (_u = 1 AND ({MO} OR {MC})))""", f"{p}_out"


def d13(inp, p):
    el = "kind IN ('open', 'close', 'void')"
    return f"""
{p}_0 AS (SELECT * FROM {inp} WHERE NOT (kind = 'close' AND NOT matched)),
{p}_1 AS (SELECT *, sum(CASE WHEN {el} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS _run,
    last_value(CASE WHEN {el} THEN tag END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _prev,
    first_value(CASE WHEN {el} THEN tag END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS _next
  FROM {p}_0),
{p}_2 AS (SELECT *, min(CASE WHEN kind = 'text' THEN CAST({blank()} AS INTEGER) END)
                      OVER (PARTITION BY doc_id, _run) = 1 AS _all_blank FROM {p}_1),
{p}_out AS (SELECT * EXCLUDE (_run, _prev, _next, _all_blank) FROM {p}_2
            WHERE NOT (kind = 'text' AND _all_blank AND (coalesce(_prev IN {in_list(BLOCK_TAGS)}, false)
                                                         OR coalesce(_next IN {in_list(BLOCK_TAGS)}, false))))""", \
        f"{p}_out"


def with_table_headers(inp_tree, p):
    w = "PARTITION BY doc_id, table_pos"
    return f"""{enclosing(inp_tree, p + "_h1", "tag = 'table'", "table_pos")},
{p}_h2 AS (SELECT *, max(CASE WHEN tag = 'thead' AND {MO} AND parent_pos = table_pos THEN 1 ELSE 0 END) OVER ({w}) AS _thead,
                     min(CASE WHEN tag = 'tr' AND kind = 'open' THEN pos END) OVER ({w}) AS _first_tr FROM {p}_h1),
{p}_h3 AS (SELECT *, min(CASE WHEN tag IN ('td', 'th') AND kind = 'open' AND parent_pos = _first_tr
                              THEN CAST(tag = 'th' AS INTEGER) END) OVER ({w}) AS _all_th FROM {p}_h2),
{p}_hh AS (SELECT * EXCLUDE (_thead, _first_tr, _all_th), _thead = 1 OR coalesce(_all_th = 1, true) AS has_header
           FROM {p}_h3)""", f"{p}_hh"


def e6(inp_tree, p):
    hh, hh_out = with_table_headers(inp_tree, p)
    body = f"(tag = 'tbody' AND parent_tag = 'table' AND NOT has_header AND ({MO} OR {MC}))"
    struct_ws = f"({blank()} AND parent_tag IN ('table', 'thead', 'tbody', 'tfoot', 'tr'))"
    return f"""{hh},
{p}_out AS (SELECT * EXCLUDE (table_pos, has_header) FROM {hh_out}
            WHERE NOT (coalesce({body}, false) OR coalesce({struct_ws}, false)))""", f"{p}_out"


def base(inp, p):
    """Drop derived span / tree columns before re-deriving them."""
    return f"\n{p}_out AS (SELECT {BASE} FROM {inp})", f"{p}_out"


def html(inp, docs, col="simple_html"):
    piece = f"coalesce({esc_text('before')}, '') || {token_html()}"
    return (f"(SELECT d.doc_id, coalesce(h.{col}, '') AS {col} FROM {docs} d LEFT JOIN "
            f"(SELECT doc_id, string_agg({piece}, '' ORDER BY pos) AS {col} FROM {inp} GROUP BY doc_id) h "
            f"ON d.doc_id = h.doc_id)")


class Chain:
    """Accumulates CTEs; ``step(fn, *args)`` feeds the current relation to a generator."""

    def __init__(self, first: str):
        self.ctes: list[str] = []
        self.cur = first
        self.n = 0

    def step(self, fn, *args, **kw):
        self.n += 1
        ctes, out = fn(self.cur, f"r{self.n}", *args, **kw)
        self.ctes.append(ctes)
        self.cur = out
        return self

    def spans(self):
        return self.step(lambda inp, p: (spans_ctes(inp, p), f"{p}_spans"))

    def tree(self):
        return self.step(lambda inp, p: (tree_ctes(inp, p), f"{p}_tree"))

    def respan(self):
        return self.step(base).spans()

    def sql(self) -> str:
        return ",".join(self.ctes)
