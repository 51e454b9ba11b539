"""SQL text for the DuckDB oracle.

The oracle is an independent, set-based restatement of each query in portable SQL (DuckDB dialect: RE2 regexes
with the ``'g'`` flag, ``\\1`` back-references, ``string_agg(.. ORDER BY ..)``, ``unnest``). Only the fixed
values (patterns, markers, word lists) are shared with the Spark code; the plans are written separately.
"""

from __future__ import annotations

import re

from ..functions.text import BASE64_IMAGE, BASE64_REPLACEMENT, DECIMAL, ENTITIES, HEXADECIMAL, LAST_CODE_POINT, \
    MAX_PAYLOAD_CHARS, MD_ESCAPES, NAMED
from ..operators import nodes as N
from ..operators import render_md as R


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """Java regex -> RE2: drop possessive quantifiers (same matches, no backtracking either way)."""
    return pattern.replace("*+", "*").replace("++", "+")


def rep2(replacement: str) -> str:
    """Java replacement ``$1`` -> RE2 ``\\1``."""
    return re.sub(r"\$(\d)", r"\\\1", replacement)


def rx(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {q(re2(pattern))}, {q(rep2(replacement))}, 'g')"


def chain(expr: str, rules) -> str:
    for p, r in rules:
        if p == R.CODE_RULE:
            expr = code_spans(expr)
        else:  # the line-break placeholder is substituted literally (its replacement may hold a backslash)
            expr = f"replace({expr}, {q(R.BREAK)}, {q(r)})" if p == R.BREAK else rx(expr, p, r)
    return expr


def code_spans(expr: str) -> str:
    """Contents between code marks, delimited by the shortest run of backticks that they don't hold."""
    runs = "list_transform(regexp_extract_all(p, '`+'), lambda r: length(r))"
    ticks = f"repeat('`', list_min(list_filter(range(1, len({runs}) + 2), lambda k: NOT list_contains({runs}, k))))"
    edge = "CASE WHEN starts_with(p, '`') OR ends_with(p, '`') THEN ' ' ELSE '' END"
    parts = f"regexp_split_to_array({expr}, {q('[' + R.C_OPEN + R.C_CLOSE + ']')})"
    return f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 0 THEN {ticks} || {edge} || p || {edge} || {ticks} ELSE p END), '')"


def decode(expr: str) -> str:
    names = "map([" + ", ".join(q(n) for n in ENTITIES) + "], [" + ", ".join(q(c) for c in ENTITIES.values()) + "])"
    rest = "regexp_replace(p, '^[^;]*;', '')"

    def number(n):
        return (f"CASE WHEN {n} > 0 AND {n} <= {LAST_CODE_POINT} AND NOT {n} BETWEEN 55296 AND 57343 "
                f"THEN chr(CAST({n} AS INTEGER)) ELSE chr(65533) END")

    dec = f"CAST(regexp_extract(p, {q(DECIMAL)}, 1) AS BIGINT)"
    hexa = f"CAST('0x' || regexp_extract(p, {q(HEXADECIMAL)}, 1) AS BIGINT)"
    part = (f"CASE WHEN i = 1 THEN p WHEN regexp_matches(p, {q(DECIMAL)}) THEN {number(dec)} || {rest} "
            f"WHEN regexp_matches(p, {q(HEXADECIMAL)}) THEN {number(hexa)} || {rest} "
            f"WHEN {names}[regexp_extract(p, {q(NAMED)}, 1)] IS NOT NULL THEN {names}[regexp_extract(p, {q(NAMED)}, 1)] || {rest} "
            f"ELSE '&' || p END")
    return (f"(CASE WHEN contains({expr}, '&') THEN array_to_string(list_transform(string_split({expr}, '&'), "
            f"lambda p, i: {part}), '') ELSE {expr} END)")


def md_escape(expr: str) -> str:
    return chain(expr, MD_ESCAPES)


def in_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def attr(col: str, name: str) -> str:
    """Value of attribute ``name`` in a list of {k, v} (first wins), '' when absent."""
    return f"coalesce(list_filter({col}, lambda p: p.k = {q(name)})[1].v, '')"


RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


# elements dropped with their content; the oracle's documents have none inside one of its kind
SUBTREES = "(?is)" + "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in N.DROP_SUBTREES)


def nodes_ctes(src: str, prefix: str = "n", allowed=None, attr_allow=None, pre_spans: str = "") -> tuple[str, str]:
    """CTEs turning ``src(doc_id, html)`` into nodes with spans and tree; returns (ctes, final_name).

    ``allowed``: tag allowlist applied before spans (a disallowed tag is unwrapped: its tokens go).
    ``attr_allow``: attribute allowlist (``aria-*`` always kept); ``[]`` drops every attribute.
    ``pre_spans``: extra WHERE condition on the classified tokens (e.g. repairs that drop tokens).
    """
    conds = []
    if allowed:
        conds.append(f"(kind = 'text' OR tag IN {in_list(allowed)})")
    if pre_spans:
        conds.append(f"({pre_spans})")
    keep = ("WHERE " + " AND ".join(conds)) if conds else ""
    if attr_allow is None:
        attrs_expr = "attrs0"
    elif attr_allow:
        attrs_expr = f"list_filter(attrs0, lambda p: p.k IN {in_list(attr_allow)} OR starts_with(p.k, 'aria-'))"
    else:
        attrs_expr = "CASE WHEN attrs0 IS NOT NULL THEN list_filter(attrs0, lambda p: false) END"
    tok_re = q(re2(N.TOKEN_RE))
    attr_items = f"regexp_extract_all(regexp_replace(tok, {q('^<[A-Za-z][^\\s/>]*|/?>$')}, '', 'g'), " \
                 f"{q(re2(N.ATTR_RE))}, 0)"
    pairs0 = (f"list_transform({attr_items}, lambda x: {{'k': lower(regexp_extract(x, {q('^([^\\s\"' + chr(39) + '>/=]+)')}, 1)), "
              f"'v': regexp_extract(x, {q('(?s)^[^=]*=\\s*(.*)$')}, 1)}})")
    unq = (f"list_transform(pairs0, lambda p: {{'k': p.k, 'v': "
           f"{decode('CASE WHEN regexp_matches(p.v, ' + q(chr(40) + '?s)^(' + chr(34) + '[^' + chr(34) + ']*' + chr(34) + '|' + chr(39) + '[^' + chr(39) + ']*' + chr(39) + ')$') + ') THEN substring(p.v, 2, length(p.v) - 2) ELSE p.v END')}}})")
    p = prefix
    spans_tree = spans_ctes(f"{p}_nodes", p) + "," + tree_ctes(f"{p}_spans", p)
    ctes = f"""
{p}_tok AS (
  SELECT doc_id, unnest(t) AS tok, unnest(range(len(t))) AS pos
  FROM (SELECT doc_id, regexp_extract_all({rx(rx('html', N.STRIP_RE, ''), SUBTREES, '')}, {tok_re}, 0) AS t FROM {src})
),
{p}_c0 AS (
  SELECT doc_id, pos, tok,
         substring(tok, 1, 1) = '<' AND length(tok) > 1 AS is_tag
  FROM {p}_tok
),
{p}_c1 AS (
  SELECT doc_id, pos, tok, is_tag,
         CASE WHEN is_tag THEN lower(regexp_extract(tok, {q(N.TAG_NAME_RE)}, 1)) END AS tag
  FROM {p}_c0
),
{p}_c2 AS (
  SELECT doc_id, pos, tok, tag,
         CASE WHEN NOT is_tag THEN 'text' WHEN substring(tok, 1, 2) = '</' THEN 'close'
              WHEN tag IN {in_list(N.VOID_TAGS)} THEN 'void' ELSE 'open' END AS kind,
         CASE WHEN NOT is_tag THEN {decode('tok')} END AS text
  FROM {p}_c1
),
{p}_c3 AS (
  SELECT *, CASE WHEN kind IN ('open', 'void') THEN {pairs0} END AS pairs0 FROM {p}_c2
),
{p}_c4 AS (
  SELECT * EXCLUDE (pairs0), CASE WHEN pairs0 IS NOT NULL THEN {unq} END AS pairs1 FROM {p}_c3
),
{p}_c5 AS (
  SELECT doc_id, pos, kind, tag, text,
         list_filter(pairs1, lambda x, i: list_position(list_transform(pairs1, lambda y: y.k), x.k) = i) AS attrs0
  FROM {p}_c4
),
{p}_nodes AS (
  SELECT doc_id, pos, kind, tag, text, {attrs_expr} AS attrs FROM {p}_c5 {keep}
),
{spans_tree}"""
    return ctes, f"{p}_tree"


def spans_ctes(inp: str, p: str) -> str:
    """CTE ``{p}_spans``: input columns + end_pos, matched, open_pos, opener_attrs (stack matching per tag)."""
    return f"""
{p}_s1 AS (
  SELECT *, CASE WHEN kind IN ('open', 'close') THEN
              sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END)
                OVER (PARTITION BY doc_id, tag ORDER BY pos {RUN}) END AS lvl
  FROM {inp}
),
{p}_s2 AS (SELECT *, CASE WHEN kind = 'close' THEN lvl + 1 ELSE lvl END AS lv FROM {p}_s1),
{p}_s3 AS (
  SELECT *,
         CASE WHEN kind IN ('open', 'close') THEN lead(kind) OVER w END AS nk,
         CASE WHEN kind IN ('open', 'close') THEN lead(pos) OVER w END AS np,
         CASE WHEN kind IN ('open', 'close') THEN lag(kind) OVER w END AS pk,
         CASE WHEN kind IN ('open', 'close') THEN lag(pos) OVER w END AS pp,
         CASE WHEN kind IN ('open', 'close') THEN lag(attrs) OVER w END AS pa
  FROM {p}_s2 WINDOW w AS (PARTITION BY doc_id, tag, lv ORDER BY pos)
),
{p}_s4 AS (
  SELECT * EXCLUDE (lvl, lv, nk, np, pk),
         CASE WHEN kind = 'open' AND nk = 'close' THEN np WHEN kind = 'void' THEN pos END AS end_pos,
         CASE WHEN kind = 'open' THEN coalesce(nk = 'close', false)
              WHEN kind = 'close' THEN coalesce(pk = 'open', false) ELSE true END AS matched
  FROM {p}_s3
),
{p}_spans AS (
  SELECT * EXCLUDE (pp, pa),
         CASE WHEN kind = 'close' AND matched THEN pp END AS open_pos,
         CASE WHEN kind = 'close' AND matched THEN pa END AS opener_attrs
  FROM {p}_s4
)"""


def tree_ctes(inp: str, p: str) -> str:
    """CTE ``{p}_tree``: input columns + depth, parent_pos, parent_tag."""
    return f"""
{p}_t1 AS (
  SELECT *, (sum(CASE WHEN kind = 'open' AND matched THEN 1 WHEN kind = 'close' AND matched THEN -1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY pos {RUN})
             - CASE WHEN kind = 'open' AND matched THEN 1 ELSE 0 END)::INTEGER AS depth
  FROM {inp}
),
{p}_t2 AS (
  SELECT *, 0 AS role, depth AS k FROM {p}_t1
  UNION ALL
  SELECT *, 1 AS role, depth + 1 AS k FROM {p}_t1 WHERE kind = 'open' AND matched
),
{p}_t3 AS (
  SELECT *, last_value(CASE WHEN role = 1 THEN pos END IGNORE NULLS)
              OVER (PARTITION BY doc_id, k ORDER BY pos, role DESC {RUN}) AS parent_pos,
            last_value(CASE WHEN role = 1 THEN tag END IGNORE NULLS)
              OVER (PARTITION BY doc_id, k ORDER BY pos, role DESC {RUN}) AS parent_tag
  FROM {p}_t2
),
{p}_tree AS (SELECT * EXCLUDE (role, k) FROM {p}_t3 WHERE role = 0)"""


def enclosing(inp: str, out: str, el: str, col: str) -> str:
    """CTE ``out``: the rows of ``inp`` with the position of the nearest element ``el`` that holds them."""
    return f"""
{out}_d AS (SELECT *, sum(CASE WHEN {el} AND kind = 'open' AND matched THEN 1 WHEN {el} AND kind = 'close' AND matched THEN -1 ELSE 0 END)
              OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS nest FROM {inp}),
{out} AS (SELECT * EXCLUDE (nest), last_value(CASE WHEN {el} AND kind = 'open' AND matched THEN pos END IGNORE NULLS)
            OVER (PARTITION BY doc_id, nest ORDER BY pos {RUN}) AS {col} FROM {out}_d)"""


def render_md_ctes(tree: str, docs: str, prefix: str = "m", before: bool = False,
                   rules: str | None = None, options: dict | None = None) -> tuple[str, str]:
    """CTEs rendering Markdown from a node tree; ``docs(doc_id)`` lists every document. Returns (ctes, name).
    ``before``: the tree carries text inserted by repairs, rendered ahead of its token."""
    p = prefix
    opts = R.resolve_options(options)
    finish_rules = R.finish_rules(opts)
    if rules:
        tree = (f"(SELECT t.*, r.r_action, r.r_open, r.r_close FROM {tree} t LEFT JOIN (SELECT tag, action AS r_action, "
                f"open_md AS r_open, close_md AS r_close FROM (SELECT *, row_number() OVER (PARTITION BY tag "
                f"ORDER BY priority DESC) AS rn FROM {rules}) WHERE rn = 1) r ON t.tag = r.tag)")
    before_piece = f"coalesce({md_escape(rx('before', '[ \\t\\r\\n\\f]+', ' '))}, '') || " if before else ""
    href_open = f"(tag = 'a' AND kind = 'open' AND matched AND {attr('attrs', 'href')} <> '')"
    href_close = f"(tag = 'a' AND kind = 'close' AND matched AND {attr('opener_attrs', 'href')} <> '')"
    block = f"(kind IN ('open', 'close', 'void') AND tag IN {in_list(N.RENDER_BLOCK_TAGS)})"
    mark = "CASE " + " ".join(f"WHEN tag = {q(t)} THEN {q(c)}" for t, c in R.MARK_CLASS.items()) + " END"
    if rules:
        mark = f"CASE WHEN r_action IS NULL THEN {mark} END"

    def run_inside(t):
        return (f"sum(CASE WHEN tag = {q(t)} AND kind = 'open' AND matched THEN 1 "
                f"WHEN tag = {q(t)} AND kind = 'close' AND matched THEN -1 ELSE 0 END) "
                f"OVER (PARTITION BY doc_id ORDER BY pos {RUN})")

    def clean_attr(e):
        return rx(e, "(\\n+\\s*)+", "\n")

    rule_runs = ""
    rule_piece = ""
    if rules:
        def inside(a):
            return (f"sum(CASE WHEN r_action = {q(a)} AND kind = 'open' AND matched THEN 1 WHEN r_action = {q(a)} "
                    f"AND kind = 'close' AND matched THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos {RUN})")
        rule_runs = f",\n    {inside('remove')} AS _rm, {inside('keep')} AS _kp"
        rule_piece = (f"WHEN _rm > 0 OR (r_action = 'remove' AND kind = 'close' AND matched) THEN '' "
                      f"WHEN _kp > 0 OR (r_action = 'keep' AND kind = 'close' AND matched) THEN {token_html()} "
                      f"WHEN r_action = 'replace' AND kind = 'open' THEN coalesce(r_open, '') "
                      f"WHEN r_action = 'replace' AND kind = 'close' AND matched THEN coalesce(r_close, '') ")

    href = rx(attr("opener_attrs", "href"), "([()])", "\\\\$1")
    title = clean_attr(attr("opener_attrs", "title"))
    link_close = (f"{q(R.L_CLOSE + '](')} || {href} || CASE WHEN {title} <> '' THEN ' \"' || "
                  f"{rx(title, chr(34), chr(92) * 2 + chr(34))} || '\"' ELSE '' END || {q(')' + R.L_END)}")
    referenced = opts["link_style"] == "referenced"
    if referenced:
        link_close = f"{q(R.L_CLOSE + '][')} || CAST(link_no AS VARCHAR) || {q(']' + R.L_END)}"
    ref_title = clean_attr(attr("opener_attrs", "title"))
    ref_line = (f"'[' || CAST(link_no AS VARCHAR) || ']: ' || {attr('opener_attrs', 'href')} || "
                f"CASE WHEN {ref_title} <> '' THEN ' \"' || {ref_title} || '\"' ELSE '' END")
    alt = clean_attr(attr("attrs", "alt"))
    src = attr("attrs", "src")
    ititle = clean_attr(attr("attrs", "title"))
    image = (f"CASE WHEN {src} <> '' THEN '![' || {alt} || '](' || {src} || "
             f"CASE WHEN {ititle} <> '' THEN ' \"' || {ititle} || '\"' ELSE '' END || ')' ELSE '' END")
    opener = "CASE mk " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.OPENERS.items()) + " END"
    closer = "CASE mk " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.CLOSERS.items()) + " END"
    text = rx("text", "[ \\t\\r\\n\\f]+", " ")
    text = f"CASE WHEN prev_break THEN ltrim({text}, ' ') ELSE {text} END"
    raw = (f"raw || repeat({q(R.C_CLOSE)}, n_c) || repeat({q(R.E_CLOSE)}, n_e) || repeat({q(R.S_CLOSE)}, n_s)")
    code = "regexp_replace(raw, '\\n\\z', '')"
    fc = opts["fence"][0]
    fence = (f"repeat({q(fc)}, CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all({code}, "
             f"{q('(?m)^(' + chr(92) + fc + '{3,})')}, 1), lambda r: length(r) + 1)), 3)) AS BIGINT))")
    fenced = f"{fence} || chr(10) || {code} || chr(10) || {fence}"
    setext = "heading || body0"
    if opts["heading_style"] == "setext":
        setext = ("CASE WHEN level <= 2 THEN body0 || chr(10) || repeat(CASE WHEN level = 1 THEN '=' ELSE '-' END, "
                  "CAST(length(body0) AS BIGINT)) ELSE heading || body0 END")
    if opts["code_block_style"] == "indented":
        fenced = f"'    ' || replace({code}, chr(10), chr(10) || '    ')"
    def pad(n):
        return f"chr(10) || repeat(' ', CAST({n} * 4 AS BIGINT)) || chr(10)"

    ctes = f"""
{p}_r0 AS (
  SELECT *, tag = 'pre' AND kind = 'open' AND matched AND
            coalesce(lead(kind) OVER (PARTITION BY doc_id ORDER BY pos) = 'open'
                     AND lead(tag) OVER (PARTITION BY doc_id ORDER BY pos) = 'code', false) AS pre_code
  FROM {tree}
),
{p}_r1 AS (
  SELECT *, sum(CASE WHEN {href_open} THEN 1 WHEN {href_close} THEN -1 ELSE 0 END)
              OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS link_run,
         {run_inside('pre')} AS pre_run,
         last_value(CASE WHEN tag = 'pre' AND kind = 'open' AND matched THEN pre_code END IGNORE NULLS)
           OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS pre_has_code,
         {href_open} AS ho, {href_close} AS hc, {block} AS blk
  FROM {p}_r0
),
{p}_r1b AS (
  SELECT *, pre_run > 0 AND coalesce(pre_has_code, false) AND NOT (tag = 'pre' AND kind = 'open' AND matched) AS in_cb
  FROM {p}_r1
),
{p}_r2 AS (
  SELECT *, blk AND NOT (link_run > 0 AND NOT ho) AND NOT in_cb AS bnd,
            blk AND (link_run > 0 AND NOT ho) AND NOT in_cb AS fld FROM {p}_r1b
),
{p}_r3 AS (
  SELECT *,
    sum(CASE WHEN bnd THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS seg,
    last_value(CASE WHEN bnd THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS seg_start,
    first_value(CASE WHEN bnd THEN pos END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_bnd,
    {run_inside('code')} AS code_run, {run_inside('li')} AS li_run, {run_inside('blockquote')} AS bq_run,
    {run_inside('table')} AS tab_run,
    sum(CASE WHEN tag IN ('td', 'th') AND kind = 'open' AND matched THEN 1
             WHEN tag IN ('td', 'th') AND kind = 'close' AND matched THEN -1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS cell_run,
    sum(CASE WHEN tag IN ('ul', 'ol') AND kind = 'open' AND matched THEN 1
             WHEN tag IN ('ul', 'ol') AND kind = 'close' AND matched THEN -1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS list_run,
    sum(CASE WHEN tag IN ('thead', 'tbody', 'tfoot') AND kind = 'open' AND matched THEN 1
             WHEN tag IN ('thead', 'tbody', 'tfoot') AND kind = 'close' AND matched THEN -1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS sec_run,
    last_value(CASE WHEN tag IN ('thead', 'tbody', 'tfoot') AND kind = 'open' AND matched THEN tag END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS sec0,
    coalesce(lag(bnd OR fld OR (kind = 'void' AND tag = 'br')) OVER (PARTITION BY doc_id ORDER BY pos), true)
      AS prev_break,
    {mark} AS mk{rule_runs},
    sum(CASE WHEN ho THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS link_no
  FROM {p}_r2
),
{p}_r4 AS (
  SELECT *,
    {before_piece}CASE {rule_piece}WHEN in_cb THEN (CASE WHEN kind = 'text' AND code_run > 0 THEN text ELSE '' END)
         WHEN kind = 'text' THEN (CASE WHEN code_run > 0 THEN {text} ELSE {md_escape(text)} END)
         WHEN fld THEN {q(R.FIELD)}
         WHEN bnd THEN ''
         WHEN kind = 'void' AND tag = 'br' THEN {q(R.BR)}
         WHEN kind = 'void' AND tag = 'img' THEN {image}
         WHEN ho THEN {q(R.L_OPEN)}
         WHEN hc THEN {link_close}
         WHEN mk IS NOT NULL AND kind = 'open' THEN {opener}
         WHEN mk IS NOT NULL AND kind = 'close' AND matched AND open_pos IS NOT NULL
              AND (seg_start IS NULL OR open_pos > seg_start) THEN {closer}
         ELSE '' END AS piece,
    kind = 'open' AND NOT (matched AND (next_bnd IS NULL OR end_pos < next_bnd)) AS dangling,
    CASE WHEN tag = 'li' AND kind = 'open' THEN
      sum(CASE WHEN tag = 'li' AND kind = 'open' THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, parent_pos ORDER BY pos {RUN}) END AS li_idx,
    last_value(CASE WHEN tag IN ('ul', 'ol') AND kind = 'open' AND matched AND list_run = 1 THEN pos END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS top_list0,
    last_value(CASE WHEN tag = 'blockquote' AND kind = 'open' AND matched AND bq_run = 1 THEN pos END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos {RUN}) AS top_bq0
  FROM {p}_r3
),
{p}_r5 AS (
  SELECT *,
    CASE WHEN bnd AND kind = 'open' AND regexp_matches(tag, '^h[1-6]$')
         THEN repeat('#', CAST(substring(tag, 2, 1) AS INTEGER)) || ' ' END AS heading,
    CASE WHEN bnd AND tag = 'li' AND kind = 'open' THEN
      (CASE WHEN parent_tag = 'ol' THEN CAST(li_idx AS VARCHAR) || {q(R.ORDERED_SUFFIX)} ELSE {q(opts['bullet'] + '   ')} END)
      END AS li,
    CASE WHEN bnd AND kind = 'open' AND regexp_matches(tag, '^h[1-6]$') THEN CAST(substring(tag, 2, 1) AS INTEGER) END
      AS level,
    CASE WHEN bnd THEN greatest(li_run - CASE WHEN tag = 'li' AND kind = 'open' AND matched THEN 1 ELSE 0 END, 0)
      END AS li_depth,
    CASE WHEN bnd THEN greatest(bq_run, 0) END AS bq,
    CASE WHEN bnd THEN kind = 'void' AND tag = 'hr' END AS hr,
    CASE WHEN bnd THEN pre_code END AS cb,
    CASE WHEN bnd THEN tag = 'table' AND kind = 'open' AND matched END AS tab,
    CASE WHEN bnd THEN tab_run > 0 AND NOT (tag = 'table' AND kind = 'open' AND matched) END AS in_table,
    CASE WHEN bnd THEN tag IN ('td', 'th') AND kind = 'open' END AS cell,
    CASE WHEN bnd THEN tag = 'th' END AS is_th,
    CASE WHEN bnd THEN lower(list_filter(attrs, lambda e: e.k = 'align')[1].v) END AS align,
    CASE WHEN bnd THEN parent_pos END AS row_pos,
    CASE WHEN bnd THEN sec_run > 0 END AS in_sec,
    CASE WHEN bnd THEN sec0 END AS sec,
    CASE WHEN bnd THEN tab_run END AS seg_tab_run, CASE WHEN bnd THEN cell_run END AS seg_cell_run,
    CASE WHEN bnd AND list_run > 0 THEN top_list0 END AS top_list, CASE WHEN bnd AND bq_run > 0 THEN top_bq0 END AS top_bq
  FROM {p}_r4
),
{p}_seg AS (
  SELECT doc_id, seg, string_agg(piece, '' ORDER BY pos) AS raw,
         string_agg(CASE WHEN kind = 'text' THEN {md_escape(rx('text', '[ \\t\\r\\n\\f]+', ' '))} ELSE '' END, ''
                    ORDER BY pos) AS plain,
         max(align) AS align, bool_or(tab) AS tab, bool_or(in_table) AS in_table, coalesce(bool_or(cb), false) AS cb, bool_or(cell) AS cell, bool_or(is_th) AS is_th,
         max(row_pos) AS row_pos, bool_or(in_sec) AS in_sec, max(sec) AS sec,
         max(seg_tab_run) AS tab_run, max(seg_cell_run) AS cell_run, max(top_list) AS top_list, max(top_bq) AS top_bq,
         max(heading) AS heading, max(level) AS level, max(li) AS li, max(li_depth) AS li_depth, max(bq) AS bq,
         coalesce(bool_or(hr), false) AS hr,
         CAST(sum(CASE WHEN dangling AND mk = 'e' THEN 1 ELSE 0 END) AS BIGINT) AS n_e,
         CAST(sum(CASE WHEN dangling AND mk = 's' THEN 1 ELSE 0 END) AS BIGINT) AS n_s,
         CAST(sum(CASE WHEN dangling AND mk = 'c' THEN 1 ELSE 0 END) AS BIGINT) AS n_c
  FROM {p}_r5 GROUP BY doc_id, seg
),
{p}_seg2 AS (
  SELECT *, CASE WHEN cb THEN {fenced} ELSE {chain(raw, finish_rules)} END AS body0, '' AS ind FROM {p}_seg
),
{p}_it1 AS (
  SELECT *, sum(CASE WHEN li IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg {RUN}) AS item
  FROM {p}_seg2
),
{p}_it2 AS (
  SELECT *, min(CASE WHEN body0 <> '' OR hr THEN seg END) OVER (PARTITION BY doc_id, item) AS first_seg,
         max(li) OVER (PARTITION BY doc_id, item) AS item_li,
         max(CASE WHEN li IS NOT NULL THEN li_depth END) OVER (PARTITION BY doc_id, item) AS item_depth
  FROM {p}_it1
),
{p}_it3 AS (
  SELECT *, coalesce(li IS NULL AND seg = first_seg AND coalesce(li_depth, 0) = item_depth + 1, false) AS moved FROM {p}_it2
),
{p}_seg3 AS (
  SELECT * EXCLUDE (ind), CASE WHEN li IS NOT NULL THEN li WHEN moved THEN item_li END AS marker,
    CASE WHEN moved THEN coalesce(li_depth, 0) - 1 ELSE coalesce(li_depth, 0) END AS depth,
    li IS NULL AND coalesce(li_depth, 0) > 0 AS loose,
    CASE WHEN heading IS NOT NULL THEN {setext}
         WHEN hr THEN (CASE WHEN body0 = '' THEN {q(opts['hr'])} ELSE {q(opts['hr'] + chr(10) + chr(10))} || body0 END)
         ELSE body0 END AS b1
  FROM {p}_it3
),
{p}_seg4 AS (
  SELECT *, CASE WHEN marker IS NOT NULL THEN depth + 1 ELSE depth END AS li_in,
    CASE WHEN marker IS NOT NULL THEN ind || marker || replace(b1, chr(10), chr(10) || ind || repeat(' ', CAST(length(marker) AS BIGINT)))
         WHEN depth > 0 THEN ind || replace(b1, chr(10), chr(10) || ind) ELSE b1 END AS b2
  FROM (SELECT *, repeat(' ', CAST(depth * 4 AS BIGINT)) AS ind FROM {p}_seg3)
),
{p}_seg4b AS (
  SELECT *, coalesce(cell, false) AND coalesce(in_table, false) AS is_cell,
         last_value(CASE WHEN tab THEN seg END IGNORE NULLS) OVER (PARTITION BY doc_id, tab_run ORDER BY seg {RUN}) AS table_seg,
         CASE WHEN coalesce(bq, 0) > 0 THEN repeat('> ', CAST(bq AS BIGINT)) || replace(b2, chr(10), chr(10) || repeat('> ', CAST(bq AS BIGINT)))
              ELSE b2 END AS block
  FROM {p}_seg4
),
{p}_seg4c AS (
  SELECT *, last_value(CASE WHEN is_cell THEN seg END IGNORE NULLS) OVER w AS cell_seg
  FROM {p}_seg4b WINDOW w AS (PARTITION BY doc_id, tab_run, cell_run ORDER BY seg {RUN})
),
{p}_seg4d AS (
  SELECT *, is_cell OR (NOT coalesce(tab, false) AND coalesce(in_table AND cell_run > 0, false) AND cell_seg IS NOT NULL) AS of_cell
  FROM {p}_seg4c
),
{p}_cells AS (
  SELECT doc_id, cell_seg AS seg, max(table_seg) FILTER (is_cell) AS table_seg, max(row_pos) FILTER (is_cell) AS row_pos,
         regexp_replace(coalesce(string_agg(CASE WHEN is_cell THEN body0 ELSE block END, chr(10) ORDER BY seg)
                          FILTER (CASE WHEN is_cell THEN body0 ELSE block END <> ''), ''), '\\s*\\n\\s*', '<br>', 'g') AS md,
         trim(regexp_replace(string_agg(plain, '' ORDER BY seg), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS pl,
         bool_or(is_th) FILTER (is_cell) AS is_th, bool_or(coalesce(in_sec AND sec = 'thead', false)) FILTER (is_cell) AS in_thead,
         max(CASE align WHEN 'left' THEN ':--' WHEN 'right' THEN '--:' WHEN 'center' THEN ':-:' ELSE '---' END) FILTER (is_cell) AS bd
  FROM {p}_seg4d WHERE of_cell GROUP BY doc_id, cell_seg
),
{p}_rows AS (
  SELECT doc_id, table_seg, row_pos, bool_and(is_th) AS all_th, bool_or(in_thead) AS in_thead, count(*) AS n,
         '| ' || string_agg(md, ' | ' ORDER BY seg) || ' |' AS line,
         '| ' || string_agg(pl, ' | ' ORDER BY seg) || ' |' AS line_plain,
         '| ' || string_agg(bd, ' | ' ORDER BY seg) || ' |' AS border
  FROM {p}_cells GROUP BY doc_id, table_seg, row_pos
),
{p}_rows2 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, table_seg ORDER BY row_pos) AS rn,
         bool_or(in_thead) OVER (PARTITION BY doc_id, table_seg) AS has_thead FROM {p}_rows
),
{p}_tabs AS (
  SELECT doc_id, table_seg AS seg,
    max(CASE WHEN rn = 1 THEN (CASE WHEN has_thead OR all_th THEN line ELSE line_plain END) END) || chr(10) ||
    max(CASE WHEN rn = 1 THEN (CASE WHEN has_thead OR all_th THEN border ELSE
      '| ' || array_to_string(repeat(['---'], CAST(n AS BIGINT)), ' | ') || ' |' END) END) ||
    CASE WHEN count(*) > 1 THEN chr(10) || string_agg(line, chr(10) ORDER BY row_pos) FILTER (WHERE rn > 1) ELSE '' END
      AS block
  FROM {p}_rows2 GROUP BY doc_id, table_seg
),
{p}_seg5 AS (
  SELECT doc_id, seg, marker IS NOT NULL AS is_li, block, top_list, top_bq, coalesce(bq, 0) AS bq, loose, li_in
  FROM {p}_seg4d WHERE (body0 <> '' OR hr) AND NOT of_cell AND NOT coalesce(tab, false)
  UNION ALL
  SELECT t.doc_id, t.seg, false AS is_li, t.block, c.top_list, c.top_bq, c.bq, c.loose, c.li_in
  FROM {p}_tabs t JOIN (SELECT doc_id, table_seg AS seg, max(top_list) AS top_list, max(top_bq) AS top_bq,
                               coalesce(max(bq), 0) AS bq, bool_or(loose) AS loose, max(li_in) AS li_in FROM {p}_seg4d WHERE of_cell GROUP BY ALL) c
    ON t.doc_id = c.doc_id AND t.seg = c.seg
),
{p}_seg6 AS (
  SELECT doc_id, seg,
    CASE WHEN is_li AND coalesce(lag(is_li) OVER w OR lag(loose) OVER w, false) AND top_list IS NOT DISTINCT FROM lag(top_list) OVER w
           THEN CASE WHEN coalesce(lag(loose) OVER w, false) THEN {pad('lag(li_in) OVER w')} ELSE chr(10) END
         WHEN loose AND top_list = lag(top_list) OVER w THEN {pad('li_in')}
         WHEN coalesce(lag(loose) OVER w, false) THEN {pad('lag(li_in) OVER w')} || chr(10)
         WHEN top_bq = lag(top_bq) OVER w AND least(bq, lag(bq) OVER w) > 0
           THEN chr(10) || repeat('> ', CAST(least(bq, lag(bq) OVER w) AS BIGINT)) || chr(10)
         ELSE chr(10) || chr(10) END || block AS joined
  FROM {p}_seg5 WINDOW w AS (PARTITION BY doc_id ORDER BY seg)
),
{p}_doc AS (
  SELECT doc_id, {rx("string_agg(joined, '' ORDER BY seg)", "^[\\t\\r\\n]+|[\\t\\r\\n ]+$", "")} AS markdown
  FROM {p}_seg6 GROUP BY doc_id
),
{p}_refs AS (
  SELECT doc_id, string_agg({ref_line}, chr(10) ORDER BY link_no) AS refs FROM {p}_r4 WHERE hc GROUP BY doc_id
),
{p}_doc2 AS (
  SELECT m.doc_id, {rx(f"CASE WHEN {'r.refs IS NOT NULL' if referenced else 'false'} THEN m.markdown || chr(10) || chr(10) || r.refs ELSE m.markdown END", "^[\\t\\r\\n]+|[\\t\\r\\n ]+$", "")} AS markdown
  FROM {p}_doc m LEFT JOIN {p}_refs r ON m.doc_id = r.doc_id
),
{p}_out AS (
  SELECT d.doc_id, coalesce(m.markdown, '') AS markdown FROM {docs} d LEFT JOIN {p}_doc2 m ON d.doc_id = m.doc_id
)"""
    return ctes, f"{p}_out"


def esc_text(e: str) -> str:
    return f"replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(160), '&nbsp;')"


def esc_attr(e: str) -> str:
    return f"replace(replace(replace({e}, '&', '&amp;'), '\"', '&quot;'), chr(160), '&nbsp;')"


def token_html(kind="kind", tag="tag", attrs="attrs", text="text", matched="matched") -> str:
    ah = (f"coalesce(array_to_string(list_transform({attrs}, lambda e: ' ' || e.k || '=\"' || {esc_attr('e.v')} "
          f"|| '\"'), ''), '')")
    return (f"CASE WHEN {kind} = 'text' THEN {esc_text(text)} "
            f"WHEN {kind} IN ('open', 'void') THEN '<' || {tag} || {ah} || '>' "
            f"WHEN {kind} = 'close' AND {matched} THEN '</' || {tag} || '>' ELSE '' END")


def html_sql(tree: str, docs: str, col: str = "html") -> str:
    """Per-document ordered concatenation of re-spelled tokens (C6), every doc of ``docs`` present."""
    return (f"(SELECT d.doc_id, coalesce(h.{col}, '') AS {col} FROM {docs} d LEFT JOIN "
            f"(SELECT doc_id, string_agg({token_html()}, '' ORDER BY pos) AS {col} FROM {tree} GROUP BY doc_id) h "
            f"ON d.doc_id = h.doc_id)")


__all__ = ["q", "re2", "rep2", "rx", "chain", "decode", "md_escape", "in_list", "attr", "nodes_ctes",
           "render_md_ctes", "MAX_PAYLOAD_CHARS", "BASE64_IMAGE", "BASE64_REPLACEMENT"]
