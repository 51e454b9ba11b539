"""Source repairs and structure cleaning on the node relation.

Every fixed-point loop of the reference has a closed form here: whether an element's subtree holds a token of some kind
is read at the opener from the next such token in document order, and at the closer from the last one. No iteration, no
per-document Python, no shuffle beyond the ``doc_id`` one.

Input nodes carry ``with_spans`` (+ ``with_tree`` where siblings matter). Operators drop tokens or rewrite
them in place (``kind``/``tag``/``attrs``); text an operator inserts goes to the ``before`` column of the token
it precedes, so positions never change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import JS_SPACE, NOT_JS_SPACE, js_trim
from .nodes import enclosing, following, nesting, nesting_name, running, w_doc
from .policy import BLOCK_TAGS, PLAIN_CONTAINERS, UNWRAPPABLE

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
#
# Fake bold wrapper.
FAKE_BOLD_STYLES = ["font-weight:normal", "font-weight: normal"]
# Pixel length (style side of E2) and vanishing length (D8; px optional so the attribute spelling matches too).
PIXEL_LENGTH = "(?i)^(\\d+(?:\\.\\d+)?)px$"
VANISHING_LENGTH = "(?i)^(\\d+(?:\\.\\d+)?)(?:px)?$"
# Naming of empty links and images.
UNNAMED = "image…"
NAME_ATTRIBUTES = ["alt", "aria-label", "title"]
NAME_PREVIEW_LENGTH = 4
ELLIPSIS = "…"
# ---------------------------------------------------------------------------------------------------------------



def _mo():
    return (F.col("kind") == "open") & F.col("matched")


def _mc():
    return (F.col("kind") == "close") & F.col("matched")


def blank_text() -> Column:
    """A text without a character that is no white space; the first one answers."""
    return (F.col("kind") == "text") & ~F.coalesce(F.col("text"), F.lit("")).rlike(NOT_JS_SPACE)


def css_value(style: Column, prop: str) -> Column:
    """Value of one declaration in a style attribute ('' when absent), trimmed and lower-cased."""
    v = F.regexp_extract(F.coalesce(style, F.lit("")), f"(?i)(?:^|;)\\s*{prop}\\s*:\\s*([^;]*)", 1)
    return F.lower(F.trim(v))


def _style(src: str = "attrs") -> Column:
    return F.col(src)["style"]


def with_holds(nodes: DataFrame, **flags: Column) -> DataFrame:
    """For every matched element (opener and closer rows) whether a flagged token stands strictly inside its span, as
    ``holds_<name>``. At the opener the next flagged token says so, at the closer the last one before it, so the tokens stay in
    document order. Where documents share a ``doc_id``, tokens share positions: of those flagged the first counts, and none is
    inside another."""
    n = nodes.withColumns({f"_f_{name}": F.when(flag, F.col("pos")) for name, flag in flags.items()})
    before = w_doc().rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumns({f"_l_{name}": F.last(f"_f_{name}", ignorenulls=True).over(before) for name in flags})
    n = n.withColumns({f"_f_{name}": F.when(~F.col(f"_f_{name}").eqNullSafe(F.col(f"_l_{name}")), F.col(f"_f_{name}")) for name in flags})
    n = n.withColumns({f"_n_{name}": following(f"_f_{name}") for name in flags})
    n = n.withColumns({f"holds_{name}": F.when(_mo(), F.coalesce(F.col(f"_n_{name}") < F.col("end_pos"), F.lit(False)))
                       .when(_mc(), F.coalesce(F.col(f"_l_{name}") > F.col("open_pos"), F.lit(False))) for name in flags})
    return n.drop(*[f"_{k}_{name}" for k in "fnl" for name in flags])


def inside(nodes: DataFrame, tags: list[str], name: str) -> DataFrame:
    """``name`` = the token sits strictly inside a matched element with one of ``tags`` (running depth > 0)."""
    t = F.col("tag").isin(tags)
    run = F.sum(F.when(t & _mo(), 1).when(t & _mc(), -1).otherwise(0)).over(running())
    own = F.when(t & _mo(), 1).otherwise(0)
    return nodes.withColumn(name, (run - own) > 0)


# ---------------------------------------------------------------------------------------------------------------
# E1 cell divs

def in_cells(spans: DataFrame) -> DataFrame:
    """What E1 has to know of each token: is it in a cell?"""
    return inside(spans, ["td", "th"], "_in_cell")


def content() -> Column:
    """An element or text that is not blank."""
    return F.col("kind").isin("open", "void") | ((F.col("kind") == "text") & ~blank_text())


def inline_cell_divs(tree: DataFrame) -> DataFrame:
    """A ``div`` inside ``td``/``th`` is unwrapped; a ``<br>`` takes the opener's place when the nearest
    previous sibling that is not blank text is content other than ``<br>``. Needs ``with_tree``; :func:`in_cells` may have run
    before it, where the tokens are in document order anyway."""
    n = tree if "_in_cell" in tree.columns else in_cells(tree)
    w = Window.partitionBy("doc_id", "parent_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(content(), F.struct(F.col("kind").alias("k"), F.col("tag").alias("t"))), ignorenulls=True).over(w)
    n = n.withColumn("_prev", prev)
    cell_div = (F.col("tag") == "div") & F.col("_in_cell")
    content_before = F.coalesce((F.col("_prev.k") == "text") | (F.col("_prev.t") != "br"), F.lit(False))
    div_open = cell_div & (F.col("kind") == "open")
    div_close = (F.col("tag") == "div") & (F.col("kind") == "close") & F.col("_in_cell")
    n = n.filter(~((div_open & ~content_before) | div_close))
    return n.withColumns({
        "attrs": F.when(div_open, F.create_map().cast("map<string,string>")).otherwise(F.col("attrs")),
        "kind": F.when(div_open, F.lit("void")).otherwise(F.col("kind")),
        "tag": F.when(div_open, F.lit("br")).otherwise(F.col("tag"))}).drop("_in_cell", "_prev")


# ---------------------------------------------------------------------------------------------------------------
# D10 fake bold, D8/D9 beacons, E2 image size

def _fake_bold(attrs: Column) -> Column:
    style = F.coalesce(attrs["style"], F.lit(""))
    return F.exists(F.array(*[F.lit(s) for s in FAKE_BOLD_STYLES]), lambda s: F.instr(style, s) > 0)


def unwrap_fake_bold(spans: DataFrame) -> DataFrame:
    """``<b style="font-weight:normal">`` (with or without the space) loses its tags, keeps its content."""
    is_b = F.col("tag") == "b"
    drop = (is_b & (F.col("kind") == "open") & _fake_bold(F.col("attrs"))) | \
           (is_b & _mc() & _fake_bold(F.col("opener_attrs")))
    return spans.filter(~F.coalesce(drop, F.lit(False)))


def is_vanishing(c: Column) -> Column:
    """A length of at most one pixel, with or without ``px``."""
    m = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), VANISHING_LENGTH, 1)
    return (m != "") & (m.cast("double") <= 1)


def beacon_reason(attrs: Column) -> Column:
    """Why an image is a beacon (NULL when it is not)."""
    style = attrs["style"]
    return (F.when(css_value(style, "display") == "none", F.lit("display:none"))
             .when(css_value(style, "visibility") == "hidden", F.lit("visibility:hidden"))
             .when(is_vanishing(css_value(style, "width")) | is_vanishing(attrs["width"]), F.lit("width<=1"))
             .when(is_vanishing(css_value(style, "height")) | is_vanishing(attrs["height"]), F.lit("height<=1")))


def drop_invisible_images(spans: DataFrame) -> DataFrame:
    """D8 + D9: remove beacon images; then remove an anchor this emptied (no element child left, blank text).
    Anchors that were empty before are not touched."""
    n = spans.withColumn("_beacon", (F.col("tag") == "img") & (F.col("kind") == "void") & beacon_reason(F.col("attrs")).isNotNull())
    n = with_holds(n, beacon=F.col("_beacon"), other=content() & ~F.col("_beacon"))
    emptied = (F.col("tag") == "a") & F.col("holds_beacon") & ~F.col("holds_other")
    # tokens inside a removed anchor go with it (they are blank text by construction)
    n = n.withColumn("_cover", F.max(F.when(_mo() & emptied, F.col("end_pos"))).over(running()))
    n = n.filter(~F.col("_beacon") & ~F.coalesce((F.col("pos") <= F.col("_cover")), F.lit(False)))
    return n.drop("_beacon", "holds_beacon", "holds_other", "_cover")


def pixel_size(style: Column, axis: str) -> Column:
    """The rounded pixel value of ``width``/``height`` in a style, as text (NULL unless a px length)."""
    m = F.regexp_extract(css_value(style, axis), PIXEL_LENGTH, 1)
    return F.when(m != "", F.round(m.cast("double")).cast("bigint").cast("string"))


def transcribe_image_size(nodes: DataFrame) -> DataFrame:
    """Pixel width/height from an image's style become attributes (style wins; other units ignored).
    An existing attribute keeps its place, a new one is appended (width before height)."""
    img = (F.col("tag") == "img") & (F.col("kind") == "void") & F.col("attrs")["style"].isNotNull()
    n = nodes.withColumns({"_w": F.when(img, pixel_size(_style(), "width")),
                           "_h": F.when(img, pixel_size(_style(), "height"))})
    ents = F.map_entries("attrs")
    ents = F.transform(ents, lambda e: F.struct(e["key"].alias("key"), F.when(
        (e["key"] == "width") & F.col("_w").isNotNull(), F.col("_w")).when(
        (e["key"] == "height") & F.col("_h").isNotNull(), F.col("_h")).otherwise(e["value"]).alias("value")))
    add_w = F.when(F.col("_w").isNotNull() & ~F.array_contains(F.map_keys("attrs"), "width"),
                   F.array(F.struct(F.lit("width").alias("key"), F.col("_w").alias("value"))))
    add_h = F.when(F.col("_h").isNotNull() & ~F.array_contains(F.map_keys("attrs"), "height"),
                   F.array(F.struct(F.lit("height").alias("key"), F.col("_h").alias("value"))))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    new = F.map_from_entries(F.concat(ents, F.coalesce(add_w, empty), F.coalesce(add_h, empty)))
    return n.withColumn("attrs", F.when(img & (F.col("_w").isNotNull() | F.col("_h").isNotNull()), new)
                        .otherwise(F.col("attrs"))).drop("_w", "_h")


# ---------------------------------------------------------------------------------------------------------------
# E7 naming

def js_trim_end(c: Column) -> Column:
    return F.regexp_replace(c, f"{JS_SPACE}+$", "")


def element_name(attrs: Column) -> Column:
    """First non-blank of alt, aria-label, title (trimmed)."""
    vals = [F.when(js_trim(F.coalesce(attrs[a], F.lit(""))) != "", js_trim(attrs[a])) for a in NAME_ATTRIBUTES]
    return F.coalesce(*vals)


def preview(name: Column) -> Column:
    return F.when(name.isNotNull(), F.concat(js_trim_end(F.substring(name, 1, NAME_PREVIEW_LENGTH)), F.lit(ELLIPSIS))) \
            .otherwise(F.lit(UNNAMED))


def _set_attr(attrs: Column, key: str, value: Column) -> Column:
    """Set one attribute: replaced in place when present, appended otherwise."""
    ents = F.transform(F.map_entries(attrs), lambda e: F.struct(
        e["key"].alias("key"), F.when(e["key"] == key, value).otherwise(e["value"]).alias("value")))
    add = F.when(~F.array_contains(F.map_keys(attrs), key), F.array(F.struct(F.lit(key).alias("key"),
                                                                            value.alias("value"))))
    return F.map_from_entries(F.concat(ents, F.coalesce(add, F.array().cast("array<struct<key:string,value:string>>"))))


def name_empty_links_and_images(spans: DataFrame) -> DataFrame:
    """An anchor with no text and no image, or an image with a blank ``alt``, gets a short name from
    ``alt`` / ``aria-label`` / ``title`` (``image…`` when none) and the full name in ``title``.
    Runs after sanitize (beacons are already gone)."""
    name, opener_name = element_name(F.col("attrs")), element_name(F.col("opener_attrs"))
    n = with_holds(spans, shown=((F.col("kind") == "text") & ~blank_text()) | (F.col("tag") == "img"))
    # where documents share a doc_id the first of the closers that share an opener's position gets the name
    n = n.withColumn("_again", F.coalesce(F.lag(F.when(_mc(), F.col("open_pos"))).over(w_doc()) == F.col("open_pos"), F.lit(False)))
    empty_a = (F.col("tag") == "a") & ~F.col("holds_shown")
    img_unnamed = (F.col("tag") == "img") & (F.col("kind") == "void") & (js_trim(F.coalesce(F.col("attrs")["alt"], F.lit(""))) == "")
    # the anchor's old children are replaced by the preview text, carried by its closer
    n = n.withColumn("_cover", F.max(F.when(_mo() & empty_a, F.col("end_pos"))).over(running()))
    inner = (F.col("pos") < F.col("_cover")) & ~(_mo() & empty_a)
    n = n.filter(~F.coalesce(inner, F.lit(False)))
    n = n.withColumn("_name", F.when((_mo() & empty_a) | img_unnamed, name))
    with_title = F.when(F.col("_name").isNotNull(), _set_attr(F.col("attrs"), "title", F.col("_name"))) \
                  .otherwise(F.col("attrs"))
    n = n.withColumn("attrs", F.when(img_unnamed, _set_attr(with_title, "alt", preview(F.col("_name"))))
                     .when(_mo() & empty_a, with_title).otherwise(F.col("attrs")))
    # closer of a named anchor: carry the preview (the opener's name) as inserted text
    of_empty = _mc() & empty_a & ~F.col("_again")
    before = F.when(of_empty, preview(opener_name))
    if "before" in n.columns:
        before = F.when(before.isNotNull(), F.concat(F.coalesce("before", F.lit("")), before)).otherwise(F.col("before"))
    # the closer carries its opener's attributes (link rendering reads href / title there): keep them in step
    named = of_empty & opener_name.isNotNull()
    n = n.withColumns({"before": before,
                       "opener_attrs": F.when(named, _set_attr(F.col("opener_attrs"), "title", opener_name))
                       .otherwise(F.col("opener_attrs"))})
    return n.drop("holds_shown", "_again", "_cover", "_name")


# ---------------------------------------------------------------------------------------------------------------
# D11-D13 collapse

def drop_empty_containers(spans: DataFrame) -> DataFrame:
    """D11 in closed form: a plain container goes (with its subtree) iff nothing inside is non-blank text or an
    element other than a plain container - exactly what repeating "remove the empty ones" converges to."""
    cont = F.col("tag").isin(PLAIN_CONTAINERS)
    alive = ((F.col("kind") == "text") & ~blank_text()) | (F.col("kind").isin("open", "void") & ~cont)
    n = with_holds(spans, alive=alive | F.col("before").isNotNull() if "before" in spans.columns else alive)
    dead = cont & _mo() & ~F.col("holds_alive")
    n = n.withColumn("_cover", F.max(F.when(dead, F.col("end_pos"))).over(running()))
    n = n.filter(~F.coalesce(F.col("pos") <= F.col("_cover"), F.lit(False)))
    return n.drop("holds_alive", "_cover")


def unwrap_single_child_divs(tree: DataFrame) -> DataFrame:
    """A ``div`` whose only non-blank child is a plain container or ``figure`` loses its tags. Judged on
    the children after D11; unwrapping never changes the verdict of another div, so one pass is the fixed point.
    Needs ``with_tree``.

    Windows only: every matched opener is seen twice - as a child (keyed by its parent) and as a parent (keyed
    by itself, as its closer is) - so one ``(doc_id, key)`` window computes each element's child statistics at both its tags."""
    kind, tag = F.col("kind"), F.col("tag")
    child = content()
    x = tree.withColumn("_role", F.explode(F.when(_mo(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    x = x.withColumn("_key", F.when(F.col("_role") == 1, F.col("pos")).when(_mc(), F.col("open_pos")).otherwise(F.col("parent_pos")))
    w = Window.partitionBy("doc_id", "_key")
    as_child = (F.col("_role") == 0) & child
    n_kids = F.sum(F.when(as_child, 1).otherwise(0)).over(w)
    kid_tag = F.max(F.when(as_child & (kind == "open"), tag)).over(w)
    other = F.max(F.when(as_child & (kind != "open"), 1).otherwise(0)).over(w)
    x = x.withColumn("_unwrap", (tag == UNWRAPPABLE) & (n_kids == 1) & (other == 0)
                     & F.coalesce(kid_tag.isin(PLAIN_CONTAINERS + ["figure"]), F.lit(False)))
    own = F.when(_mo(), F.col("_role") == 1).otherwise(True)
    return x.filter(own & ~F.coalesce(F.col("_unwrap") & (_mo() | _mc()), F.lit(False))).drop("_role", "_key", "_unwrap")


def drop_dead_whitespace(nodes: DataFrame) -> DataFrame:
    """D13 (+C5): a run of adjacent whitespace-only text tokens goes when the element token right before or
    right after it is a block element (a sibling, or the parent's own tag - both are block boundaries)."""
    el = F.col("kind").isin("open", "close", "void")
    n = nodes.filter(~((F.col("kind") == "close") & ~F.col("matched")))
    # a run of text is bounded by the nearest element tokens on either side; it is blank if from each of its blank tokens
    # an element, and no other text, comes next on both sides
    bound = F.when(el | ((F.col("kind") == "text") & ~blank_text()), F.struct(el.alias("el"), F.col("tag").alias("t")))
    n = n.withColumn("_bound", bound)
    n = n.withColumns({"_prev": F.last("_bound", ignorenulls=True).over(w_doc().rowsBetween(Window.unboundedPreceding, -1)),
                       "_next": following("_bound")})
    of_run = lambda c: F.coalesce(F.col(c)["el"], F.lit(True))
    by_block = lambda c: F.coalesce(F.col(c)["t"].isin(BLOCK_TAGS), F.lit(False))
    dead = blank_text() & of_run("_prev") & of_run("_next") & (by_block("_prev") | by_block("_next"))
    return n.filter(~dead).drop("_bound", "_prev", "_next")


# ---------------------------------------------------------------------------------------------------------------
# E4 / E6 tables

def nested_in_tables(spans: DataFrame) -> DataFrame:
    """In how many tables each token stands."""
    return spans.withColumn(nesting_name("table_pos"), nesting(F.col("tag") == "table"))


def with_table_headers(tree: DataFrame) -> DataFrame:
    """E4 as windows: ``table_pos`` (nearest enclosing table) and ``has_header`` for its table: a
    ``thead`` child, or no rows, or every cell of the first row is ``th``. Needs ``with_tree``; :func:`nested_in_tables` may
    have run before it, where the tokens are in document order anyway."""
    kind, tag = F.col("kind"), F.col("tag")
    n = enclosing(tree, tag == "table", "table_pos")
    w = Window.partitionBy("doc_id", "table_pos")
    n = n.withColumns({
        "_thead": F.max(F.when((tag == "thead") & _mo() & (F.col("parent_pos") == F.col("table_pos")), 1)
                        .otherwise(0)).over(w),
        "_first_tr": F.min(F.when((tag == "tr") & (kind == "open"), F.col("pos"))).over(w)})
    cell_of_first = tag.isin("td", "th") & (kind == "open") & (F.col("parent_pos") == F.col("_first_tr"))
    n = n.withColumn("_all_th", F.min(F.when(cell_of_first, (tag == "th").cast("int"))).over(w))
    n = n.withColumn("has_header", (F.col("_thead") == 1) | F.coalesce(F.col("_all_th") == 1, F.lit(True)))
    return n.drop("_thead", "_first_tr", "_all_th")


def table_headers(tree: DataFrame) -> DataFrame:
    """E4 per matched table ``(doc_id, table_pos, has_header)``."""
    n = with_table_headers(tree)
    return n.filter((F.col("tag") == "table") & _mo()).select("doc_id", "table_pos", "has_header")


def with_simplified_tables(tree: DataFrame) -> DataFrame:
    """E6 as a column: ``_tidied`` for the tokens that the Simple HTML goes without - the ``tbody`` tags of a headerless table
    and whitespace-only text directly inside ``table/thead/tbody/tfoot/tr``. Needs ``with_tree``."""
    n = with_table_headers(tree)
    body_of_headerless = (F.col("tag") == "tbody") & (F.col("parent_tag") == "table") & ~F.col("has_header") \
        & (_mo() | _mc())
    struct_ws = blank_text() & F.col("parent_tag").isin("table", "thead", "tbody", "tfoot", "tr")
    tidied = F.coalesce(body_of_headerless, F.lit(False)) | F.coalesce(struct_ws, F.lit(False))
    return n.withColumn("_tidied", tidied).drop("table_pos", "has_header")


def simplify_tables(tree: DataFrame) -> DataFrame:
    """E6 (Simple HTML only): the tokens of ``with_simplified_tables`` that stay."""
    return with_simplified_tables(tree).filter(~F.col("_tidied")).drop("_tidied")
