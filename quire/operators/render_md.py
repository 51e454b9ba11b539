"""The Markdown rendering job (K1-K18): ``nodes -> (doc_id, markdown)``.

One corpus job instead of a recursive tree walk:

1. every block element token (outside a link) starts a *segment*; ``seg`` is a running count over the
   document, so a segment is a block's direct inline content;
2. each token becomes a *piece*: escaped text, ``**``/``_``/backtick markers, link and image syntax;
   inline markers are in-band private-use characters so a fixed chain of ``regexp_replace`` can move
   flanking whitespace outside them and drop blank ones (K8, K17);
3. pieces are concatenated per segment in ``pos`` order, finished, prefixed (heading ``#``, list marker and
   indent, blockquote ``>``) and joined per document with one blank line between blocks, a single newline
   between list items (K1, K5, K18).

All windows are ``partitionBy(doc_id, ...)``; the two aggregations group by ``(doc_id, seg)`` and ``doc_id``.
Hash partitioning on ``doc_id`` satisfies all of them, so the job has exactly one exchange (the payload
repartition in :func:`quire.operators.nodes.tokenize`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MARKER_CLASS, collapse_ws, md_escape
from .nodes import RENDER_BLOCK_TAGS, following, ordered_concat, running, w_doc

# In-band markers: private-use code points. Those of the input are escaped on the way in and restored at the end.
BR = "\ue000"
S_OPEN, S_CLOSE = "\ue001", "\ue002"
E_OPEN, E_CLOSE = "\ue003", "\ue004"
C_OPEN, C_CLOSE = "\ue005", "\ue006"
FIELD = "\ue007"
L_OPEN, L_CLOSE, L_END = "\ue008", "\ue009", "\ue00a"
# white space of a ``pre`` that no rule may collapse, and a line break once its surroundings are trimmed
KEPT_SPACES = "\ue00b\ue00c\ue00d"
BREAK = "\ue00e"

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results (renderer options in force).
HR = "* * *"
BULLET = "*   "            # bullet marker followed by three spaces
ORDERED_SUFFIX = ".  "     # "1.  "
LINE_BREAK = "  \n"        # two spaces + newline
STRONG, EMPHASIS, CODE = "**", "_", "`"
LINK_FIELD_SEPARATOR = " — "
# ---------------------------------------------------------------------------------------------------------------

# Renderer options (the defaults are the ones in force in the reference's conversion)
DEFAULT_OPTIONS = {"heading_style": "atx", "hr": HR, "bullet": "*", "code_block_style": "fenced", "fence": "```",
                   "em": EMPHASIS, "strong": STRONG, "br": "  ", "link_style": "inlined"}


def resolve_options(options: dict | None) -> dict:
    o = dict(DEFAULT_OPTIONS)
    o.update(options or {})
    return o


# Classes that name the language of a code block.
HIGHLIGHTED, LANGUAGE = "highlight-(?:text|source)-([a-z0-9]+)", "language-(\\S+)"

MARK_CLASS = {"b": "s", "strong": "s", "i": "e", "em": "e", "code": "c"}
OPENERS = {"s": S_OPEN, "e": E_OPEN, "c": C_OPEN}
CLOSERS = {"s": S_CLOSE, "e": E_CLOSE, "c": C_CLOSE}

# Stands in FINISH for :func:`code_spans`.
CODE_RULE = "code spans"

# (pattern, replacement) applied in order to a segment's concatenated pieces.
FINISH = [
    (f"[\\s{FIELD}]*{FIELD}[\\s{FIELD}]*", LINK_FIELD_SEPARATOR),
    (f"{L_OPEN}{LINK_FIELD_SEPARATOR}", L_OPEN),
    (f"{LINK_FIELD_SEPARATOR}{L_CLOSE}", L_CLOSE),
    (" {2,}", " "),
    (f"([{S_OPEN}{E_OPEN}{C_OPEN}{L_OPEN}]+) +", " $1"),
    (f" +([{S_CLOSE}{E_CLOSE}{C_CLOSE}]+|{L_CLOSE}[^{L_END}]*{L_END})", "$1 "),
    (" {2,}", " "),
    (f"{S_OPEN}(\\s*){S_CLOSE}", "$1"),
    (f"{E_OPEN}(\\s*){E_CLOSE}", "$1"),
    (f"{C_OPEN}{C_CLOSE}", ""),
    (f" *{BR} *", BREAK),
    (f"[{S_OPEN}{S_CLOSE}]", "**"),
    (f"[{E_OPEN}{E_CLOSE}]", "_"),
    (CODE_RULE, ""),
    (L_OPEN, "["),
    (f"[{L_CLOSE}{L_END}]", ""),
    (f"^[ \\t\\r\\n{BREAK}]+|[ \\t\\r\\n{BREAK}]+$", ""),
    (BREAK, "  \n"),
]


MARKERS = "[\ue000-\ue00a]"
INLINE_MARKS = S_OPEN + S_CLOSE + E_OPEN + E_CLOSE + C_OPEN + C_CLOSE
# rules whose pattern is a plain literal run as ``replace`` (no regex)
LITERAL_RULES = {(L_OPEN, "[")}
LITERAL_PATTERNS = {BREAK}


def code_spans(c: Column) -> Column:
    """K7: the delimiter of a code span is the shortest run of backticks that its content does not hold, and a space keeps
    a backtick at its edge apart. Spans don't nest, so every second part between their marks is a content."""
    def span(p: Column) -> Column:
        lengths = F.transform(F.regexp_extract_all(p, F.lit("(`+)"), 1), lambda r: F.length(r))
        ticks = F.repeat(F.lit("`"), F.array_min(F.array_except(F.sequence(F.lit(1), F.size(lengths) + 1), lengths)))
        edge = F.when(p.rlike("^`|`$"), F.lit(" ")).otherwise(F.lit(""))
        return F.concat(ticks, edge, p, edge, ticks)

    parts = F.split(c, f"[{C_OPEN}{C_CLOSE}]", -1)
    spelled = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, span(p)).otherwise(p)), "")
    return F.when(F.instr(c, C_OPEN) > 0, F.when(F.instr(c, "`") > 0, spelled).otherwise(F.regexp_replace(c, f"[{C_OPEN}{C_CLOSE}]", "`"))).otherwise(c)


def guard(c: Column) -> Column:
    """The input's own marks, escaped: U+E00F and a code point from U+E010 on."""
    out = F.replace(c, F.lit("\ue00f"), F.lit("\ue00f\ue01f"))
    for k in range(15):
        out = F.replace(out, F.lit(chr(0xE000 + k)), F.lit("\ue00f" + chr(0xE010 + k)))
    return F.when(c.rlike(MARKER_CLASS), out).otherwise(c)


def unguard(c: Column) -> Column:
    out = c
    for k in range(16):
        out = F.replace(out, F.lit("\ue00f" + chr(0xE010 + k)), F.lit(chr(0xE000 + k)))
    return F.when(F.instr(c, "\ue00f") > 0, out).otherwise(c)


def _apply(c: Column, rules) -> Column:
    for pat, rep in rules:
        if pat == CODE_RULE:
            c = code_spans(c)
            continue
        literal = (pat, rep) in LITERAL_RULES or pat in LITERAL_PATTERNS
        c = F.replace(c, F.lit(pat), F.lit(rep)) if literal else F.regexp_replace(c, pat, rep)
    return c


def finish_rules(opts: dict | None = None) -> list:
    """FINISH with the option-dependent replacements (strong / emphasis delimiters, line break)."""
    o = resolve_options(opts)
    out = []
    for pat, rep in FINISH:
        if pat == f"[{S_OPEN}{S_CLOSE}]":
            rep = o["strong"].replace("$", "\\$")
        elif pat == f"[{E_OPEN}{E_CLOSE}]":
            rep = o["em"].replace("$", "\\$")
        elif pat == BREAK:
            rep = o["br"] + "\n"
        out.append((pat, rep))
    return out


def finish(c: Column, opts: dict | None = None) -> Column:
    """The FINISH chain. Segments without any in-band marker (plain prose) take a two-step fast path that gives
    the same result: collapse double spaces, trim."""
    rules = finish_rules(opts)
    fields = _apply(c, rules[:3])      # link fields only
    c3 = F.when(F.instr(c, FIELD) > 0, fields).otherwise(c)
    # the rules of strong, emphasis and code alone do nothing where none of their marks is
    others = [(pat, rep) for pat, rep in rules[3:] if pat != CODE_RULE and not (set(pat) & set(INLINE_MARKS) and L_OPEN not in pat and L_CLOSE not in pat)]
    full = F.when(c.rlike(f"[{INLINE_MARKS}]"), _apply(c3, rules[3:])).otherwise(_apply(c3, others))
    plain = F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")
    return F.when(c.rlike(MARKERS), full).otherwise(plain)


def _attr(name: str, src: str = "attrs") -> Column:
    return guard(F.coalesce(F.col(src)[name], F.lit("")))


def clean_attribute(c: Column) -> Column:
    """Newline runs inside an attribute squeezed to one."""
    return F.regexp_replace(c, "(\\n+\\s*)+", "\n")


def _link_close(src: str) -> Column:
    href = F.regexp_replace(_attr("href", src), "([()])", "\\\\$1")
    title = clean_attribute(_attr("title", src))
    title_part = F.when(title != "", F.concat(F.lit(' "'), F.regexp_replace(title, '"', '\\\\"'), F.lit('"')))
    return F.concat(F.lit(L_CLOSE + "]("), href, F.coalesce(title_part, F.lit("")), F.lit(")" + L_END))


def _reference_line(src: str) -> Column:
    """K19 reference-style links: ``[n]: href "title"`` (href and title as written, newlines squeezed)."""
    title = clean_attribute(_attr("title", src))
    return F.concat(F.lit("["), F.col("_link_no").cast("string"), F.lit("]: "), _attr("href", src),
                    F.when(title != "", F.concat(F.lit(' "'), title, F.lit('"'))).otherwise(F.lit("")))


def _image() -> Column:
    alt = clean_attribute(_attr("alt"))
    src = _attr("src")
    title = clean_attribute(_attr("title"))
    title_part = F.when(title != "", F.concat(F.lit(' "'), title, F.lit('"'))).otherwise(F.lit(""))
    return F.when(src != "", F.concat(F.lit("!["), alt, F.lit("]("), src, title_part, F.lit(")"))).otherwise("")


# What joins a block to the one before it: the outermost list and quote, how deep it is quoted, whether it is a block of
# an item rather than the item's own text, and how many items it is in.
FRAME = -2     # the row number of what a table has outside its cells
STYLE = ["top_list", "top_bq", "bq", "loose", "li_in"]


def _grouped(x: DataFrame, items: str, out: str, *keys: str) -> DataFrame:
    """The array ``items`` as an array ``out`` of arrays: neighbours with the same ``keys`` together. One pass over the places at
    which a group begins."""
    same = lambda a, b: reduce(lambda m, k: m & a[k].eqNullSafe(b[k]), keys[1:], a[keys[0]].eqNullSafe(b[keys[0]]))
    begins = lambda v, i: F.when((i == 0) | ~same(F.get(F.col(items), i - 1), v), i)
    x = x.withColumn("_at", F.filter(F.transform(items, begins), lambda i: i.isNotNull()))
    return x.withColumn(out, F.transform("_at", lambda a, j: F.slice(items, a + 1, F.coalesce(F.get(F.col("_at"), j + 1), F.size(items)) - a))).drop("_at")


def _blocks(segs: DataFrame, refs: bool = False, also: bool = False) -> DataFrame:
    """Segments -> blocks ``(doc_id, seg, block, is_li)`` in one linear flow (no branch re-reads the input).

    Ordinary segments pass through one aggregate as one-row groups; the parts of a table's cells meet in the group placed at the
    table's own segment, in order, where neighbours become cells and cells become rows - K12 with E5: a table without a
    header row (no ``thead``, first row not all ``th``) gets its first row promoted as plain text (inline markup
    lost, as in the reference). K13: a table whose ``thead`` has no row is neither promoted nor has it a heading row, so it
    stays markup; that is gathered next to the rows."""
    h = F.col("head")
    is_cell = F.coalesce(h["cell"] & h["in_table"], F.lit(False))
    is_table = F.coalesce(h["table"], F.lit(False))
    # the nearest enclosing table and cell: the last one opened at the same nesting depth
    by_table = Window.partitionBy("doc_id", h["tab_run"]).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    by_cell = Window.partitionBy("doc_id", h["tab_run"], h["cell_run"]).orderBy("seg").rowsBetween(
        Window.unboundedPreceding, 0)
    segs = segs.withColumns({"_is_cell": is_cell, "_table_seg": F.last(F.when(is_table, F.col("seg")), True).over(by_table)})
    segs = segs.withColumn("_cell", F.last(F.when(is_cell, F.struct(
        F.col("seg"), F.col("_table_seg").alias("table_seg"), h["row_pos"].alias("row_pos"))), True).over(by_cell))
    # blocks inside a cell are part of it; what a table holds outside its cells stays a block of its own, if it is any
    part = ~F.col("_is_cell") & ~is_table & F.coalesce(h["in_table"] & (h["cell_run"] > 0), F.lit(False)) \
        & F.col("_cell").isNotNull()
    of_cell = F.col("_is_cell") | part
    kept = (F.col("body") != "") | F.coalesce(h["hr"], F.lit(False))
    frame = ~of_cell & (is_table | (F.coalesce(h["in_table"], F.lit(False)) & ~kept & F.col("_table_seg").isNotNull()))
    own = lambda c, other: F.when(of_cell, F.col("_cell")[c]).when(frame, F.col("_table_seg") if c == "table_seg" else F.lit(FRAME)).otherwise(other)
    joined = F.array_join(F.transform("markup", lambda m: m["v"]), "")
    bit = F.struct("seg", (F.col("also") if also else F.lit("")).alias("also"), joined.alias("markup"))
    bits = F.array(bit) if also else F.when(of_cell | frame, F.array(bit)).otherwise(F.array().cast("array<struct<seg:bigint,also:string,markup:string>>"))
    # empty segments stay as placeholders (kept = false) so every document reaches the final aggregate
    x = segs.select(
        "doc_id", (of_cell | frame).alias("is_cell"), (of_cell | kept).alias("kept"), own("table_seg", F.col("seg")).alias("k1"),
        own("row_pos", F.lit(-1)).alias("k2"), own("seg", F.col("seg")).alias("k3"), "seg", "block", "is_li", *STYLE,
        F.when(F.col("_is_cell"), F.col("body")).otherwise(F.col("block")).alias("md"), "plain", bits.alias("bits"),
        F.when(frame, h["thead"]).alias("thead"), *(["facts"] if also else []),
        # Border cell from the cell's align attribute (only present when the sanitizer did not run)
        F.when(F.col("_is_cell"), F.coalesce(
            F.when(h["align"] == "left", F.lit(":--")).when(h["align"] == "right", F.lit("--:"))
             .when(h["align"] == "center", F.lit(":-:")), F.lit("---"))).alias("bd"),
        F.when(F.col("_is_cell"), h["is_th"]).alias("is_th"),
        F.when(F.col("_is_cell"), h["in_sec"] & (h["sec"] == "thead")).alias("in_thead"),
        *(["refs"] if refs else []))
    cell = F.when(F.col("is_cell") & ~F.col("k2").eqNullSafe(F.lit(FRAME)), F.struct("k2", "k3", "seg", "md", "plain", "bd", "is_th", "in_thead"))
    x = x.groupBy("doc_id", "is_cell", "k1").agg(
        F.flatten(F.collect_list("bits")).alias("bits"), F.max("thead").alias("thead"),
        *([F.first("facts", ignorenulls=True).alias("facts")] if also else []),
        *([F.flatten(F.collect_list("refs")).alias("refs")] if refs else []),
        F.array_sort(F.collect_list(cell)).alias("_parts"), F.max("block").alias("block"), F.max("is_li").alias("is_li"),
        F.max("kept").alias("kept"), *[F.max(c).alias(c) for c in STYLE])
    kept_cols = ["bits", "thead", *(["facts"] if also else []), *(["refs"] if refs else [])]
    x = _grouped(x, "_parts", "_cells", "k2", "k3")
    said = lambda ps, c: F.transform(ps, lambda p: p[c])
    some = lambda xs, c: F.coalesce(F.exists(xs, lambda p: p[c]), F.lit(False))
    x = x.withColumn("_cells", F.transform("_cells", lambda ps: F.struct(
        F.get(ps, F.lit(0))["k2"].alias("k2"),
        F.regexp_replace(F.array_join(F.filter(said(ps, "md"), lambda m: m != ""), "\n"), "\\s*\\n\\s*", "<br>").alias("md"),
        F.trim(F.regexp_replace(F.array_join(said(ps, "plain"), ""), "[ \\t\\r\\n\\f]+", " ")).alias("pl"),
        F.coalesce(F.array_max(said(ps, "bd")), F.lit("---")).alias("bd"),
        some(ps, "is_th").alias("is_th"), some(ps, "in_thead").alias("in_thead"))))
    x = _grouped(x, "_cells", "_rows", "k2")
    line = lambda cs, c: F.concat(F.lit("| "), F.array_join(said(cs, c), " | "), F.lit(" |"))
    t = x.withColumn("rs", F.transform("_rows", lambda cs: F.struct(
        line(cs, "md").alias("line"), line(cs, "pl").alias("line_plain"), F.size(cs).alias("n"), F.forall(cs, lambda c: c["is_th"]).alias("all_th"),
        line(cs, "bd").alias("border"), some(cs, "in_thead").alias("in_thead"))))
    t = t.withColumn("has_thead", some(F.col("rs"), "in_thead"))
    first = F.get(F.col("rs"), F.lit(0))
    has_header = F.col("has_thead") | first["all_th"]
    plain_border = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), first["n"]), " | "), F.lit(" |"))
    # a promoted header row is made of new cells without alignment
    border = F.when(has_header, first["border"]).otherwise(plain_border)
    rest = F.array_join(F.transform(F.slice("rs", 2, F.greatest(F.size("rs") - 1, F.lit(1))), lambda r: r["line"]),
                        "\n")
    md = F.concat(F.when(has_header, first["line"]).otherwise(first["line_plain"]), F.lit("\n"), border,
                  F.when(F.size("rs") > 1, F.concat(F.lit("\n"), rest)).otherwise(F.lit("")))
    # the closing tag of a table stands behind its segments
    markup = F.concat(F.array_join(F.transform(F.array_sort("bits"), lambda b: b["markup"]), ""), F.lit("</table>"))
    md = F.when(F.coalesce(F.col("thead"), F.lit(False)) & ~has_header, markup).otherwise(md)
    return t.select("doc_id", F.col("k1").alias("seg"),
                    F.when(F.col("is_cell"), md).otherwise(F.col("block")).alias("block"),
                    F.when(F.col("is_cell"), F.lit(False)).otherwise(F.col("is_li")).alias("is_li"),
                    F.when(F.col("is_cell"), F.size("rs") > 0).otherwise(F.col("kept")).alias("kept"), *STYLE, *kept_cols)


def effective_rules(rules: DataFrame) -> DataFrame:
    """A rule set is a DataFrame ``(tag, action, open_md, close_md, priority)``; plugins are unions of
    rule sets. Per tag the highest priority (newest) rule wins. Spark broadcasts the set if it is small."""
    w = Window.partitionBy("tag").orderBy(F.col("priority").desc())
    return (rules.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
                 .select("tag", F.col("action").alias("r_action"), F.col("open_md").alias("r_open"),
                         F.col("close_md").alias("r_close")))


def render_markdown(nodes: DataFrame, docs: DataFrame | None = None, rules: DataFrame | None = None,
                    options: dict | None = None, html_col: str | None = None) -> DataFrame:
    """K1-K18 over sanitized nodes with spans and tree (``with_spans`` + ``with_tree``).

    ``docs`` (``doc_id`` column) lists documents that must appear even when nothing renders (markdown ``''``).
    ``rules`` (X1/X2) override the built-in rule of a tag: ``replace`` (emit ``open_md``/``close_md`` around the
    content), ``remove`` (drop the element with its content) or ``keep`` (emit the element as HTML).
    """
    opts = resolve_options(options)
    kind, tag = F.col("kind"), F.col("tag")
    if rules is not None:
        nodes = nodes.join(effective_rules(rules), "tag", "left")
    is_el = kind.isin("open", "close", "void")
    mo = (kind == "open") & F.col("matched")
    mc = (kind == "close") & F.col("matched")
    href_open = (tag == "a") & mo & (F.coalesce(F.col("attrs")["href"], F.lit("")) != "")
    href_close = (tag == "a") & mc & (F.coalesce(F.col("opener_attrs")["href"], F.lit("")) != "")

    # Window expressions are computed in batches (one projection per dependency level), so each batch is a
    # single Window operator over the document order instead of one operator per column.
    def running_inside(t):
        return F.sum(F.when(t & mo, 1).when(t & mc, -1).otherwise(0)).over(running())

    sec = tag.isin("thead", "tbody", "tfoot")
    # K7: a ``pre`` whose first child is ``code`` is a fenced code block (its content raw, one segment)
    # with the language of its class; K15: so is a ``pre`` that opens a ``div`` of a highlighted class, whatever it holds
    # (classes are there only if the sanitizer did not run)
    near = F.struct(kind.alias("k"), tag.alias("t"), F.coalesce(F.col("attrs")["class"], F.lit("")).alias("c"))
    nodes = nodes.withColumns({"_nxt": F.lead(near).over(w_doc()), "_prv": F.lag(near).over(w_doc())})
    pre_code = (F.col("_nxt.k") == "open") & (F.col("_nxt.t") == "code")
    marked = (F.col("_prv.k") == "open") & (F.col("_prv.t") == "div") & F.col("_prv.c").rlike(HIGHLIGHTED)
    nodes = nodes.withColumns({
        "_pre_code": (tag == "pre") & mo & F.coalesce(pre_code | marked, F.lit(False)),
        "_pre_lang": F.when((tag == "pre") & mo, F.when(marked, F.concat(F.lit("="), F.regexp_extract(F.col("_prv.c"), HIGHLIGHTED, 1)))
                            .when(pre_code, F.concat(F.lit("-"), F.regexp_extract(F.col("_nxt.c"), LANGUAGE, 1))))}).drop("_nxt", "_prv")
    n = nodes.withColumns({
        "_pre_run": running_inside(tag == "pre"),
        "_pre_has_code": F.last(F.when((tag == "pre") & mo, F.col("_pre_code")), ignorenulls=True).over(running()),
        "_pre_all": F.last(F.when((tag == "pre") & mo, F.coalesce(F.substring("_pre_lang", 1, 1) == "=", F.lit(False))), ignorenulls=True).over(running()),
        "_link_run": F.sum(F.when(href_open, 1).when(href_close, -1).otherwise(0)).over(running()),
        "_code_run": running_inside(tag == "code"),
        "_li_run": running_inside(tag == "li"),
        "_bq_run": running_inside(tag == "blockquote"),
        "_tab_run": running_inside(tag == "table"),
        "_cell_run": running_inside(tag.isin("td", "th")),
        "_list_run": running_inside(tag.isin("ul", "ol")),
        "_sec_run": running_inside(sec),
        "_sec": F.last(F.when(sec & mo, tag), ignorenulls=True).over(running()),
    })
    in_link = (F.col("_link_run") > 0) & ~href_open
    in_cb = (F.col("_pre_run") > 0) & F.coalesce(F.col("_pre_has_code"), F.lit(False)) & ~((tag == "pre") & mo)
    block = is_el & tag.isin(RENDER_BLOCK_TAGS)
    n = n.withColumns({"_bnd": block & ~in_link & ~in_cb, "_field": block & in_link & ~in_cb, "_in_cb": in_cb})
    n = n.withColumn("seg", F.sum(F.col("_bnd").cast("int")).over(running()))
    n = n.withColumn("_bnd_pos", F.when(F.col("_bnd"), F.col("pos")))
    # where the surrounding segment starts / the next one starts (marker balance inside a segment)
    n = n.withColumns({
        "_seg_start": F.last("_bnd_pos", ignorenulls=True).over(running()),
        "_next_bnd": following("_bnd_pos"),
        # the outermost list and blockquote that the token stands in
        "_top_list": F.last(F.when(tag.isin("ul", "ol") & mo & (F.col("_list_run") == 1), F.col("pos")), ignorenulls=True)
                      .over(running()),
        "_top_bq": F.last(F.when((tag == "blockquote") & mo & (F.col("_bq_run") == 1), F.col("pos")), ignorenulls=True)
                    .over(running()),
        "_link_no": F.sum(href_open.cast("int")).over(running()),
        "_prev_break": F.coalesce(F.lag(F.col("_bnd") | F.col("_field") | ((kind == "void") & (tag == "br"))
                                        | (kind == "doc"))
                                  .over(w_doc()), F.lit(True)),
    })
    prev_break = F.col("_prev_break")

    mark = F.coalesce(*[F.when(tag == t, F.lit(c)) for t, c in MARK_CLASS.items()])
    if rules is not None:        # a rule replaces the built-in emphasis / strong / code handling of its tag
        mark = F.when(F.col("r_action").isNull(), mark)
    n = n.withColumn("_mark", mark)
    close_in_seg = F.col("matched") & F.col("open_pos").isNotNull() & (
        F.col("_seg_start").isNull() | (F.col("open_pos") > F.col("_seg_start")))
    open_closes_in_seg = F.col("matched") & (F.col("_next_bnd").isNull() | (F.col("end_pos") < F.col("_next_bnd")))

    source = guard(F.col("text"))
    text = collapse_ws(source)
    # C4: white space inside ``pre`` stays as it is
    text = F.when(F.col("_pre_run") > 0, F.translate(source, " \n\t", KEPT_SPACES)).when(prev_break, F.ltrim(text)).otherwise(text)
    text_piece = F.when(F.col("_code_run") > 0, text).otherwise(md_escape(text))

    def mark_piece(table):
        return F.coalesce(*[F.when(F.col("_mark") == k, F.lit(v)) for k, v in table.items()])

    piece = (F.when(F.col("_in_cb"), F.when((kind == "text") & ((F.col("_code_run") > 0) | F.col("_pre_all")), source)
                                     .otherwise(F.lit("")))
             .when(kind == "text", text_piece)
             .when(F.col("_field"), F.lit(FIELD))
             .when(F.col("_bnd"), F.lit(""))
             .when((kind == "void") & (tag == "br"), F.lit(BR))
             .when((kind == "void") & (tag == "img"), _image())
             # A box at the start of an item
             .when((tag == "input") & (F.col("parent_tag") == "li") & (F.lower(F.col("attrs")["type"]) == "checkbox"),
                   F.when(F.map_contains_key("attrs", F.lit("checked")), F.lit("[x] ")).otherwise(F.lit("[ ] ")))
             .when(href_open, F.lit(L_OPEN))
             .when(href_close, _link_close("opener_attrs") if opts["link_style"] != "referenced" else
                   F.concat(F.lit(L_CLOSE + "]["), F.col("_link_no").cast("string"), F.lit("]" + L_END)))
             # code inside code is one span
             .when((F.col("_mark") == "c") & (F.col("_code_run") > F.when(mo, 1).otherwise(0)), F.lit(""))
             .when(F.col("_mark").isNotNull() & (kind == "open"), mark_piece(OPENERS))
             .when(F.col("_mark").isNotNull() & (kind == "close") & close_in_seg, mark_piece(CLOSERS))
             .otherwise(F.lit("")))
    if rules is not None:
        from .render_html import token_html
        act = F.col("r_action")

        def inside(a):
            return F.sum(F.when((act == a) & mo, 1).when((act == a) & mc, -1).otherwise(0)).over(running())
        n = n.withColumns({"_rm": inside("remove"), "_kp": inside("keep")})
        removed = (F.col("_rm") > 0) | ((act == "remove") & mc)
        kept = (F.col("_kp") > 0) | ((act == "keep") & mc)
        raw = token_html(kind, tag, F.col("attrs"), F.col("text"), F.col("matched"))
        piece = (F.when(removed, F.lit(""))
                  .when(kept, raw)
                  .when((act == "replace") & (kind == "open"), F.coalesce(F.col("r_open"), F.lit("")))
                  .when((act == "replace") & mc, F.coalesce(F.col("r_close"), F.lit("")))
                  .otherwise(piece))
    if "before" in nodes.columns:     # text inserted by a repair (E7 names) precedes the token's own piece
        piece = F.concat(F.coalesce(md_escape(collapse_ws(guard(F.col("before")))), F.lit("")), piece)
    from .render_html import token_html
    markup = token_html(kind, tag, F.col("attrs"), text, F.col("matched"))
    n = n.withColumns({"_piece": piece, "_markup": F.when(F.col("_tab_run") > 0, markup)})
    dangling = (kind == "open") & ~open_closes_in_seg & ~((F.col("_mark") == "c") & (F.col("_code_run") > 1))

    # list marker of an item: bullet, or its 1-based index among the items of its ordered list (H5)
    li_open = (tag == "li") & (kind == "open")
    if "_li_idx" not in n.columns:     # ``with_tree`` may have numbered the items
        w_items = Window.partitionBy("doc_id", "parent_pos").orderBy("pos")
        n = n.withColumn("_li_idx", F.when(li_open, F.sum(li_open.cast("int")).over(
            w_items.rowsBetween(Window.unboundedPreceding, 0))))
    li_marker = F.when(F.col("parent_tag") == "ol", F.concat(F.col("_li_idx").cast("string"), F.lit(ORDERED_SUFFIX))) \
                 .otherwise(F.lit(opts["bullet"] + "   "))
    level = F.regexp_extract(tag, "^h([1-6])$", 1)
    head = F.when(F.col("_bnd"), F.struct(
        F.when((kind == "open") & (level != ""), F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" ")))
         .alias("heading"),
        F.when((kind == "open") & (level != ""), level.cast("int")).alias("level"),
        F.when(li_open, li_marker).alias("li"),
        F.greatest(F.col("_li_run") - F.when(li_open & F.col("matched"), 1).otherwise(0), F.lit(0))
         .alias("li_depth"),
        F.greatest(F.col("_bq_run"), F.lit(0)).alias("bq"),
        ((kind == "void") & (tag == "hr")).alias("hr"),
        F.col("_pre_code").alias("cb"), F.col("_pre_lang").alias("lang"),
        # table context: the table's own segment, cells (with their row), anything else inside a table
        ((tag == "table") & mo).alias("table"), ((tag == "thead") & mo).alias("thead"),
        ((F.col("_tab_run") > 0) & ~((tag == "table") & mo)).alias("in_table"),
        (tag.isin("td", "th") & (kind == "open")).alias("cell"),
        (tag == "th").alias("is_th"),
        F.lower(F.col("attrs")["align"]).alias("align"),
        F.col("parent_pos").alias("row_pos"),
        (F.col("_sec_run") > 0).alias("in_sec"), F.col("_sec").alias("sec"),
        F.col("_tab_run").alias("tab_run"), F.col("_cell_run").alias("cell_run"),
        F.when(F.col("_list_run") > 0, F.col("_top_list")).alias("top_list"),
        F.when(F.col("_bq_run") > 0, F.col("_top_bq")).alias("top_bq")))
    n = n.withColumn("_head", head)

    referenced = opts["link_style"] == "referenced"
    ref_agg = [F.collect_list(F.when(href_close, F.struct(F.col("_link_no").alias("n"),
                                                          _reference_line("opener_attrs").alias("line"))))
               .alias("refs")] if referenced else []
    segs = (n.groupBy("doc_id", "seg").agg(
        *ref_agg,
        ordered_concat(F.col("pos"), F.col("_piece")).alias("raw"),
        # plain text is only needed for table cells (promoted headers)
        ordered_concat(F.col("pos"), F.when((kind == "text") & (F.col("_tab_run") > 0),
                                            md_escape(collapse_ws(F.col("text")))).otherwise(F.lit(""))).alias("plain"),
        F.max("_head").alias("head"),
        # The markup of tables, for those that Markdown cannot spell; and, if asked, the pieces of the other output
        F.array_sort(F.collect_list(F.when((F.col("_tab_run") > 0) & F.col("_markup").isNotNull(), F.struct("pos", F.col("_markup").alias("v"))))).alias("markup"),
        *([ordered_concat(F.col("pos"), F.col(html_col)).alias("also"), F.first(F.when(kind == "doc", F.col("attrs")), ignorenulls=True).alias("facts")] if html_col else []),
        F.sum(F.when(dangling & (F.col("_mark") == "e"), 1).otherwise(0)).alias("n_e"),
        F.sum(F.when(dangling & (F.col("_mark") == "s"), 1).otherwise(0)).alias("n_s"),
        F.sum(F.when(dangling & (F.col("_mark") == "c"), 1).otherwise(0)).alias("n_c")))
    raw = F.concat(F.col("raw"), F.repeat(F.lit(C_CLOSE), F.col("n_c")), F.repeat(F.lit(E_CLOSE), F.col("n_e")),
                   F.repeat(F.lit(S_CLOSE), F.col("n_s")))
    # K7: fence = three backticks, or one more than the longest run of 3+ backticks opening a line of the code
    lang = F.coalesce(F.col("head")["lang"], F.lit(""))
    highlighted = F.substring(lang, 1, 1) == "="
    code = F.when(highlighted, F.col("raw")).otherwise(F.regexp_replace(F.col("raw"), "\n\\z", ""))
    fc = opts["fence"][0]
    runs = F.regexp_extract_all(code, F.lit(f"(?m)^(\\{fc}{{3,}})"), 1)
    fence = F.repeat(F.lit(fc), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r) + 1)),
                                                              F.lit(3))))
    fence = F.when(highlighted, F.lit(opts["fence"])).otherwise(fence)
    fenced = F.concat(fence, F.substring(lang, 2, 100), F.lit("\n"), code, F.lit("\n"), fence)
    if opts["code_block_style"] == "indented":
        fenced = F.when(highlighted, fenced).otherwise(F.concat(F.lit("    "), F.replace(code, F.lit("\n"), F.lit("\n    "))))
    flowing = finish(raw, opts)
    as_is = F.regexp_replace(F.translate(flowing, KEPT_SPACES, " \n\t"), "^\n+|\n+$", "")
    flowing = F.when(flowing.rlike(f"[{KEPT_SPACES}]"), as_is).otherwise(flowing)
    segs = segs.withColumn("body", F.when(F.coalesce(F.col("head")["cb"], F.lit(False)), fenced).otherwise(flowing))

    # the marker of an item goes to the first of its segments that holds anything
    h = F.col("head")
    by_doc = Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    holds = (F.col("body") != "") | F.coalesce(h["hr"], F.lit(False))
    starts = h["li"].isNotNull()
    segs = segs.withColumns({
        "_marker": F.last(F.when(starts, F.struct(h["li"].alias("li"), h["li_depth"].alias("depth"))), True).over(by_doc),
        # the last segment before this one that starts an item or holds anything
        "_last": F.last(F.when(starts | holds, F.coalesce(holds, F.lit(False))), True).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))})
    li_depth = F.coalesce(h["li_depth"], F.lit(0))
    moved = h["li"].isNull() & holds & ~F.col("_last") & (li_depth == F.col("_marker.depth") + 1)
    moved = F.coalesce(moved, F.lit(False))
    marker = F.coalesce(h["li"], F.when(moved, F.col("_marker.li")))
    is_li = marker.isNotNull()
    depth = F.when(moved, li_depth - 1).otherwise(li_depth)      # items around the block's own item
    indent = F.repeat(F.lit(" "), depth * 4)
    body0 = F.col("body")

    def prefix_lines(c: Column, prefix: Column) -> Column:
        return F.concat(prefix, F.replace(c, F.lit("\n"), F.concat(F.lit("\n"), prefix)))

    heading = F.concat(h["heading"], body0)
    if opts["heading_style"] == "setext":     # K19: underlined h1 / h2
        heading = F.when(h["level"] <= 2, F.concat(body0, F.lit("\n"), F.repeat(
            F.when(h["level"] == 1, F.lit("=")).otherwise(F.lit("-")), F.length(body0)))).otherwise(heading)
    rule = F.when(body0 == "", F.lit(opts["hr"])).otherwise(F.concat(F.lit(opts["hr"] + "\n\n"), body0))
    content = (F.when(h["heading"].isNotNull(), heading)
                .when(F.coalesce(h["hr"], F.lit(False)), rule).otherwise(body0))
    body = (F.when(is_li, F.concat(indent, marker, F.replace(content, F.lit("\n"), F.concat(
                F.lit("\n"), indent, F.repeat(F.lit(" "), F.length(marker))))))
             .when(li_depth > 0, prefix_lines(content, indent))
             .otherwise(content))
    body = F.when(F.coalesce(h["bq"], F.lit(0)) > 0, prefix_lines(body, F.repeat(F.lit("> "), h["bq"]))) \
            .otherwise(body)
    segs = segs.withColumns({"loose": h["li"].isNull() & (li_depth > 0), "li_in": F.when(is_li, depth + 1).otherwise(li_depth)})
    segs = segs.withColumns({"block": body, "is_li": is_li, "top_list": h["top_list"],
                             "top_bq": h["top_bq"], "bq": h["bq"]})
    segs = _blocks(segs, referenced, html_col is not None)

    # between blocks stands an empty line. Items of one list follow each other; inside an item the empty line is
    # indented, inside a quote it is quoted
    w = Window.partitionBy("doc_id").orderBy("seg")
    prev = F.last(F.when(F.col("kept"), F.struct("is_li", *STYLE)), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    segs = segs.withColumn("_prev", prev)
    p = F.col("_prev")
    one_list = F.col("is_li") & F.coalesce(p["is_li"] | p["loose"], F.lit(False)) \
        & F.col("top_list").eqNullSafe(p["top_list"])
    one_quote = (F.col("top_bq") == p["top_bq"]) & (F.least(F.col("bq"), p["bq"]) > 0)
    quoted = F.concat(F.lit("\n"), F.repeat(F.lit("> "), F.least(F.col("bq"), p["bq"])), F.lit("\n"))
    pad = lambda n: F.concat(F.lit("\n"), F.repeat(F.lit(" "), n * 4), F.lit("\n"))
    after = F.coalesce(p["loose"], F.lit(False))
    sep = (F.when(one_list & ~after, F.lit("\n")).when(one_list, pad(p["li_in"]))
            .when(F.col("loose") & (F.col("top_list") == p["top_list"]), pad(F.col("li_in")))
            .when(after, F.concat(pad(p["li_in"]), F.lit("\n")))
            .when(one_quote, quoted).otherwise(F.lit("\n\n")))
    segs = segs.withColumn("_joined", F.when(F.col("kept"), F.concat(sep, F.col("block"))).otherwise(F.lit("")))
    out = (segs.groupBy("doc_id")
               .agg(unguard(F.regexp_replace(ordered_concat(F.col("seg"), F.col("_joined")),
                                             "^[\\t\\r\\n]+|[\\t\\r\\n ]+$", "")).alias("markdown"),
                    *([F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("bits"))), lambda b: b["also"]), "").alias("simple_html"),
                       F.first("facts", ignorenulls=True).alias("facts")] if html_col else []),
                    *([F.array_sort(F.flatten(F.collect_list("refs"))).alias("refs")] if referenced else [])))
    if referenced:     # the reference list closes the document
        lines = F.array_join(F.transform("refs", lambda r: r["line"]), "\n")
        out = out.select("doc_id", F.regexp_replace(F.when(F.size("refs") > 0, F.concat(
            F.col("markdown"), F.lit("\n\n"), unguard(lines))).otherwise(F.col("markdown")),
            "^[\\t\\r\\n]+|[\\t\\r\\n ]+$", "").alias("markdown"))
    if docs is not None:
        out = docs.select("doc_id").join(out, "doc_id", "left") \
                  .select("doc_id", F.coalesce(F.col("markdown"), F.lit("")).alias("markdown"))
    return out
