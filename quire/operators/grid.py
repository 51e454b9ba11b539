"""Tables as a relation of cells.

``cells(doc_id, table_no, r, c, section, is_header, text, html, selected, strategy)``. Every aggregate is keyed by
``(doc_id, table_no)`` or finer, so one hash exchange on ``doc_id`` serves them all, and a group is the cells of one
document's tables, never a cross product of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
STRATEGY_PRIORITY = {"native": 0, "aria": 1, "heuristic": 2}
MD_BORDER = "---"
CELL_BREAK = "<br>"
# ---------------------------------------------------------------------------------------------------------------

TABLE = ["doc_id", "table_no"]


def bounding_box(cells: DataFrame) -> DataFrame:
    """G1: rectangle of the selected cells per table (partial + final hash aggregate)."""
    return (cells.filter("selected").groupBy(*TABLE)
                 .agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")))


def repair_grid(cells: DataFrame) -> DataFrame:
    """Every position of the selection's bounding box, rebased to its corner: what a selected cell holds (``text``,
    ``html``), nothing for others; ``is_header`` is kept for every cell that exists.

    Rows are built from the cells there are: holes come from ``array_repeat`` between a cell and the one before it, empty
    rows between a row and the one before it. No grid of positions is made and nothing is joined."""
    content = [c for c in ("text", "html") if c in cells.columns]
    flags = [c for c in ("is_header",) if c in cells.columns]
    keys = [*TABLE, *[c for c in ("strategy",) if c in cells.columns]]
    of_table = Window.partitionBy(*TABLE)
    at = lambda c: F.when(F.col("selected"), F.col(c))
    n = cells.withColumns({"_r0": F.min(at("r")).over(of_table), "_r1": F.max(at("r")).over(of_table), "_c0": F.min(at("c")).over(of_table), "_c1": F.max(at("c")).over(of_table)})
    n = n.filter(F.col("r").between(F.col("_r0"), F.col("_r1")) & F.col("c").between(F.col("_c0"), F.col("_c1")))
    held = F.struct(*[F.coalesce(at(c), F.lit("")).alias(c) for c in content], *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags])
    hole = F.struct(*[F.lit("").alias(c) for c in content], *[F.lit(False).alias(c) for c in flags])
    rows = n.groupBy(*keys, "r").agg(F.array_sort(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), held.alias("v")))).alias("cs"),
                                     *[F.max(F.col(c).cast("int")).alias(c) for c in ("_r0", "_r1", "_c0", "_c1")])
    before = lambda i: F.when(i == 0, F.col("_c0") - 1).otherwise(F.get(F.col("cs"), i - 1)["c"])
    filled = F.flatten(F.transform("cs", lambda x, i: F.concat(F.array_repeat(hole, x["c"] - before(i) - 1), F.array(x["v"]))))
    row = F.concat(filled, F.array_repeat(hole, F.col("_c1") - F.element_at("cs", -1)["c"]))
    above = F.coalesce(F.lag("r").over(Window.partitionBy(*TABLE).orderBy("r")), F.col("_r0") - 1)
    rows = rows.select(*keys, F.col("r").cast("int").alias("r"), "_r0", "_c0", "_c1", row.alias("row"), above.cast("int").alias("_above"))
    empty = F.array_repeat(hole, F.col("_c1") - F.col("_c0") + 1)
    rows = rows.select(*keys, "_r0", "r", "row", empty.alias("empty"), F.explode(F.sequence(F.col("_above") + 1, F.col("r"))).alias("at"))
    out = rows.select(*keys, (F.col("at") - F.col("_r0")).alias("r"), F.posexplode(F.when(F.col("at") == F.col("r"), F.col("row")).otherwise(F.col("empty"))).alias("c", "v"))
    return out.select(*TABLE, "r", "c", *[F.col("v")[c].alias(c) for c in (*content, *flags)], *keys[len(TABLE):])


def rows_of(cells: DataFrame) -> DataFrame:
    """Cells grouped into rows, ordered by column."""
    return (cells.groupBy(*TABLE, "r")
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda s: s["text"])
                      .alias("cells")))


def md_cell(text: Column) -> Column:
    """Newlines inside a cell become ``<br>`` so the row stays on one line."""
    return F.regexp_replace(text, "\\s*\\n\\s*", CELL_BREAK)


def cells_to_markdown(cells: DataFrame) -> DataFrame:
    """One GFM table per (doc, table); the first row is the heading row, followed by the border row.

    Rows are rendered by one aggregate per row and joined by one aggregate per table - no self-join."""
    rows = (cells.groupBy(*TABLE, "r")
                 .agg(F.array_sort(F.collect_list(F.struct("c", md_cell(F.col("text")).alias("t")))).alias("cs")))
    line = F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda s: s["t"]), " | "), F.lit(" |"))
    border = F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda s: F.lit(MD_BORDER)), " | "), F.lit(" |"))
    rows = rows.select(*TABLE, "r", F.when(F.col("r") == 0, F.concat(line, F.lit("\n"), border)).otherwise(line)
                       .alias("line"))
    return (rows.groupBy(*TABLE)
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))),
                                              lambda s: s["line"]), "\n").alias("markdown")))


def ragged_report(cells: DataFrame) -> DataFrame:
    """Cells per row, min / max per table."""
    w = cells.groupBy(*TABLE, "r").agg(F.count(F.lit(1)).alias("width"))
    return (w.groupBy(*TABLE).agg(F.min("width").alias("min_w"), F.max("width").alias("max_w"))
             .withColumn("ragged", F.col("min_w") != F.col("max_w")))


def snapshot_stats(cells: DataFrame) -> DataFrame:
    """Cell and row totals per document."""
    return cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cell_count"),
                                       F.countDistinct("table_no", "r").alias("row_count"))


def selected_columns(cells: DataFrame) -> DataFrame:
    """Distinct selected columns per table."""
    return cells.filter("selected").select(*TABLE, "c").distinct()


def promote_first_row(cells: DataFrame) -> DataFrame:
    """A grid with no header cell promotes its first data row (header flag per table by window)."""
    w = Window.partitionBy(*TABLE)
    has_header = F.max(F.col("is_header").cast("int")).over(w) == 1
    first = F.col("r") == F.min("r").over(w)
    return (cells.withColumn("is_header", F.col("is_header") | (~has_header & first))
                 .withColumn("section", F.when(F.col("is_header"), F.lit("thead")).otherwise(F.col("section"))))


def pick_strategy(candidates: DataFrame, strategies: list[str] | None = None) -> DataFrame:
    """Per document the first of the strategies that produced cells wins (native, then aria, then heuristic, or the
    order of ``strategies``); unknown ones come last."""
    order = {k: i for i, k in enumerate(strategies)} if strategies else STRATEGY_PRIORITY
    prio = F.coalesce(*[F.when(F.col("strategy") == k, F.lit(v)) for k, v in order.items()], F.lit(99))
    best = F.min(prio).over(Window.partitionBy("doc_id"))
    return candidates.withColumn("_best", best).filter(prio == F.col("_best")).drop("_best")


def extract_grids(tree: DataFrame, strategies: list) -> DataFrame:
    """Cells by a list of ``(name, fn(tree) -> cells)`` in order of priority; per document the first that finds any cell
    wins. Columns that only some strategies give are null for the others."""
    found = None
    for name, fn in strategies:
        cells = fn(tree).withColumn("strategy", F.lit(name))
        found = cells if found is None else found.unionByName(cells, allowMissingColumns=True)
    return pick_strategy(found, [name for name, _ in strategies])


def first_root(cells: DataFrame) -> DataFrame:
    """Aria grids keep only the first root holding a selected cell; native tables are all kept."""
    first = F.min(F.when((F.col("strategy") == "aria") & F.col("selected"), F.col("table_no"))).over(Window.partitionBy("doc_id"))
    return cells.withColumn("_first", first).filter((F.col("strategy") != "aria") | (F.col("table_no") == F.col("_first"))).drop("_first")


def _both_sides(payload_cells: DataFrame, grid_cells: DataFrame) -> DataFrame:
    """Payload and grid cells as one relation by document, with how many cells their rows have, the widest payload row
    (``_clip``) and the width of the grid's first row (``_dom``) of each table."""
    cols = ["doc_id", "table_no", "r", "c", *[c for c in ("text", "html") if c in payload_cells.columns and c in grid_cells.columns]]
    strategy = F.col("strategy") if "strategy" in grid_cells.columns else F.lit("native")
    u = payload_cells.select(*cols, F.lit(None).cast("string").alias("strategy")).unionByName(grid_cells.select(*cols, strategy.alias("strategy")))
    u = u.repartition("doc_id").withColumn("_grid", F.col("strategy").isNotNull())
    u = u.withColumn("_w", F.count(F.lit(1)).over(Window.partitionBy(*TABLE, "_grid", "r")))
    t = Window.partitionBy(*TABLE)
    return u.withColumns({"_clip": F.max(F.when(~F.col("_grid"), F.col("_w"))).over(t),
                          "_dom": F.coalesce(F.min_by(F.when(F.col("_grid"), F.col("_w")), F.when(F.col("_grid"), F.col("r"))).over(t), F.lit(0))})


def _fits() -> Column:
    """No payload table is more than twice as wide as the first row of its grid (that would be a layout table)."""
    return ~F.coalesce((F.col("_dom") > 0) & (F.col("_clip") > F.col("_dom") * 2), F.lit(False))


def width_guard(payload_cells: DataFrame, grid_cells: DataFrame) -> DataFrame:
    """Per document with payload tables, the swap is allowed unless one of them is a layout table; tables pair up by
    ordinal. One exchange."""
    u = _both_sides(payload_cells, grid_cells).filter(~F.col("_grid"))
    return u.groupBy("doc_id").agg(F.bool_and(_fits()).alias("ok"), F.size(F.collect_set("table_no")).cast("long").alias("n_tables"))


def swap_tables(payload_cells: DataFrame, grid_cells: DataFrame) -> DataFrame:
    """F2 on cells: all-or-nothing per document: when the grid is native, table counts match and the width guard holds,
    every payload table is replaced by the grid table with the same ordinal. Windows over one relation, one exchange."""
    u, doc = _both_sides(payload_cells, grid_cells), Window.partitionBy("doc_id")
    tables = lambda side: F.size(F.collect_set(F.when(side, F.col("table_no"))).over(doc))
    u = u.withColumns({"_np": tables(~F.col("_grid")), "_ng": tables(F.col("_grid")), "_native": F.min(F.col("strategy") == "native").over(doc), "_ok": F.min(_fits()).over(doc)})
    swap = (F.col("_np") > 0) & (F.col("_np") == F.col("_ng")) & F.coalesce("_native", F.lit(False)) & F.col("_ok")
    u = u.withColumn("swapped", swap).filter(F.col("_grid") == F.col("swapped"))
    return u.select("doc_id", "table_no", "r", "c", *[c for c in ("text", "html") if c in u.columns], "swapped")


def native_cells(tree: DataFrame) -> DataFrame:
    """Native ``<table>`` -> ``cells`` with ``text`` (their own, without that of tables inside them) and ``html`` (the
    markup of the whole cell, inner tables included). Cells and sections belong to the nearest table; cells take
    their row from their parent ``tr``, rows are ranked within the table, tables within the document.
    ``colspan``/``rowspan`` are ignored (as by the reference). Needs ``with_tree``."""
    from ..functions.text import js_trim
    from .nodes import members, ordered_concat, with_closest
    from .render_html import token_html
    kind, tag = F.col("kind"), F.col("tag")
    mo = (kind == "open") & F.col("matched")
    is_cell = tag.isin("td", "th")
    is_sec = tag.isin("thead", "tbody", "tfoot")
    n = with_closest(tree, table_pos=tag == "table", cell_pos=is_cell, _sec_pos=is_sec)
    n = n.withColumn("_sec", F.when(F.col("_sec_pos") > F.col("table_pos"), F.max(F.when(is_sec & mo, tag)).over(
        Window.partitionBy("doc_id", "_sec_pos"))))
    # a token is a row for each cell around it, so one aggregate per cell gathers its text, its markup and the opener's facts
    n = members(n, is_cell, "_in")
    own = F.col("pos") == F.col("_in")
    cells = (n.groupBy("doc_id", "_in").agg(
        ordered_concat(F.col("pos"), F.when((kind == "text") & (F.col("cell_pos") == F.col("_in")), F.col("text"))).alias("text"),
        ordered_concat(F.col("pos"), F.when(~own, token_html(kind, tag, F.col("attrs"), F.col("text"), F.col("matched")))).alias("html"),
        F.max(F.when(own, F.struct(
            F.col("table_pos").alias("table_pos"), F.col("parent_pos").alias("row_pos"),
            F.coalesce("_sec", F.lit("table")).alias("section"),
            (tag == "th").alias("is_header")))).alias("o"))
        .select("doc_id", F.col("_in").alias("cell_pos"), "text", "html", "o.table_pos", "o.row_pos", "o.section", "o.is_header"))
    w_doc_t = Window.partitionBy("doc_id").orderBy("table_pos")
    w_tab = Window.partitionBy("doc_id", "table_pos").orderBy("row_pos")
    w_row = Window.partitionBy("doc_id", "table_pos", "row_pos").orderBy("cell_pos")
    return cells.select(
        "doc_id", (F.dense_rank().over(w_doc_t) - 1).alias("table_no"), "table_pos",
        (F.dense_rank().over(w_tab) - 1).alias("r"), (F.row_number().over(w_row) - 1).alias("c"),
        "section", "is_header", js_trim(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("html", F.lit("")).alias("html"), "cell_pos")


# ---------------------------------------------------------------------------------------------------------------
# ARIA grids
#
# Fixed values that must equal the reference for equal results.
ARIA_ROOT_ROLES = ["table", "grid", "treegrid"]
ARIA_GRID_CELL_ROLES = ["cell", "gridcell", "columnheader", "rowheader"]
ARIA_SELECTED_CELL_ROLES = ["cell", "gridcell", "columnheader", "rowheader"]
ARIA_CSS_SELECTED_ROLES = ["cell", "gridcell"]
ARIA_ROW_CELL_ROLES = ["cell", "columnheader", "gridcell"]   # E3 (no rowheader, unlike E9)
PREVIEW_STRATEGIES = ["aria-selected", "css-class"]
# ---------------------------------------------------------------------------------------------------------------


def element_texts(tree: DataFrame, is_el: Column, carry: dict, html: bool = False) -> DataFrame:
    """One row per matched element satisfying ``is_el``: its trimmed ``textContent`` plus ``carry`` columns
    evaluated at the opener (and its ``innerHTML``, if asked)."""
    from ..functions.text import js_trim
    from .nodes import contents
    return contents(tree, is_el, carry, html).withColumn("text", js_trim(F.coalesce("text", F.lit(""))))


def _role() -> Column:
    from .nodes import role
    return role()


def aria_cells(tree: DataFrame) -> DataFrame:
    """E9 + F6: cells of ARIA roots (``table``/``grid``/``treegrid``). A row is the nearest ``role=row`` inside a root, or the
    nearest ``tr`` unless that is a row of a table inside the root (hybrid grids: the root is the table, or has rows of
    its own). Cells of an ARIA row carry a cell role (``rowheader`` included, unlike E3), those of a ``tr`` are its ``td``
    and ``th`` children; header = ``columnheader`` or ``th``; ``selected`` = ``aria-selected="true"``. Needs ``with_tree``."""
    from .nodes import with_closest
    tag = F.col("tag")
    is_root = _role().isin(ARIA_ROOT_ROLES)
    n = with_closest(tree, root_pos=is_root, _table=tag == "table")
    native = (tag == "tr") & F.coalesce(F.col("_table") <= F.col("root_pos"), F.lit(True))
    # a closer is asked like its opener: it stands outside its own element, but in the same root, table and row
    is_row = F.col("root_pos").isNotNull() & ((_role() == "row") | native)
    n = with_closest(n, row_pos=is_row, _tr_pos=is_row & (_role() != "row"))
    in_tr = F.coalesce(F.col("_tr_pos") == F.col("row_pos"), F.lit(False))
    is_cell = F.col("root_pos").isNotNull() & F.col("row_pos").isNotNull() & F.when(
        in_tr, tag.isin("td", "th") & (F.col("parent_pos") == F.col("row_pos"))).otherwise(_role().isin(ARIA_GRID_CELL_ROLES))
    cells = element_texts(n, F.coalesce(is_cell, F.lit(False)), {
        "root_pos": F.col("root_pos"), "row_pos": F.col("row_pos"),
        "is_header": (_role() == "columnheader") | (tag == "th"),
        "selected": F.coalesce(F.col("attrs")["aria-selected"] == "true", F.lit(False)),
        "data_row": F.col("attrs")["data-row"], "data_col": F.col("attrs")["data-col"]})
    w_doc_t = Window.partitionBy("doc_id").orderBy("root_pos")
    w_tab = Window.partitionBy("doc_id", "root_pos").orderBy("row_pos")
    w_row = Window.partitionBy("doc_id", "root_pos", "row_pos").orderBy("el_pos")
    return cells.select(
        "doc_id", (F.dense_rank().over(w_doc_t) - 1).cast("int").alias("table_no"),
        (F.dense_rank().over(w_tab) - 1).cast("int").alias("r"),
        (F.row_number().over(w_row) - 1).cast("int").alias("c"),
        F.when(F.col("is_header"), F.lit("thead")).otherwise(F.lit("tbody")).alias("section"),
        "is_header", "text", "selected", F.lit("aria").alias("strategy"), "data_row", "data_col",
        F.col("el_pos").alias("pos"))


def selected_aria_cells(tree: DataFrame) -> DataFrame:
    """The preview's selected cells: ``aria-selected="true"`` with a cell role (or td/th); when a document has
    none, cells / gridcells whose class contains ``selected``. ``strategy`` says which rule found them."""
    tag = F.col("tag")
    sel = F.coalesce(F.col("attrs")["aria-selected"] == "true", F.lit(False))
    by_aria = sel & (_role().isin(ARIA_SELECTED_CELL_ROLES) | tag.isin("td", "th"))
    by_css = _role().isin(ARIA_CSS_SELECTED_ROLES) & F.coalesce(F.col("attrs")["class"].contains("selected"),
                                                                F.lit(False))
    cand = element_texts(tree, by_aria | by_css, {
        "by_aria": by_aria, "is_header": (_role() == "columnheader") | (tag == "th"),
        "data_row": F.col("attrs")["data-row"], "data_col": F.col("attrs")["data-col"]})
    w = Window.partitionBy("doc_id")
    cand = cand.withColumn("_any_aria", F.max(F.col("by_aria").cast("int")).over(w) == 1)
    return (cand.filter(F.col("by_aria") | ~F.col("_any_aria"))
                .withColumn("strategy", F.when(F.col("_any_aria"), F.lit(PREVIEW_STRATEGIES[0]))
                            .otherwise(F.lit(PREVIEW_STRATEGIES[1])))
                .drop("_any_aria", "by_aria").withColumnRenamed("el_pos", "pos"))


def num(c: Column) -> Column:
    """JavaScript ``Number()`` for ordering: NULL when not a number (sorts last, then by position)."""
    return F.trim(c).try_cast("double")


def coords_to_table(tree: DataFrame) -> DataFrame:
    """E12 + F4 + I1 + J1: the preview table rebuilt from selected cells that carry ``data-row``/``data-col``:
    rows by numeric ``data-row`` (default ``'0'``), cells by numeric ``data-col``, and the column headers of
    the selected columns prepended as row 0. One pass over the tree finds both selected cells and headers; the
    header filter is a window over ``(doc_id, data_col)`` instead of a semi-join."""
    from .nodes import running  # noqa: F401
    tag = F.col("tag")
    sel = F.coalesce(F.col("attrs")["aria-selected"] == "true", F.lit(False))
    by_aria = sel & (_role().isin(ARIA_SELECTED_CELL_ROLES) | tag.isin("td", "th"))
    by_css = _role().isin(ARIA_CSS_SELECTED_ROLES) & F.coalesce(F.col("attrs")["class"].contains("selected"),
                                                                F.lit(False))
    is_head = _role() == "columnheader"
    cand = element_texts(tree, by_aria | by_css | is_head, {
        "by_aria": by_aria, "by_css": by_css & ~by_aria, "is_colhead": is_head,
        "is_header": is_head | (tag == "th"),
        "data_row": F.col("attrs")["data-row"], "data_col": F.col("attrs")["data-col"]})
    wd = Window.partitionBy("doc_id")
    cand = cand.withColumn("_any_aria", F.max(F.col("by_aria").cast("int")).over(wd) == 1)
    cand = cand.withColumn("_sel", F.col("by_aria") | (F.col("by_css") & ~F.col("_any_aria")))
    cand = cand.withColumn("_coords", F.max((F.col("_sel") & F.col("data_row").isNotNull()
                                             & F.col("data_col").isNotNull()).cast("int")).over(wd) == 1)
    cand = cand.withColumn("_col_sel", F.max(F.col("_sel").cast("int")).over(
        Window.partitionBy("doc_id", "data_col")) == 1)
    head = F.col("is_colhead") & F.col("_col_sel") & F.col("data_col").isNotNull()
    x = cand.filter(F.col("_coords") & (F.col("_sel") | head))
    x = x.withColumn("_hdr_row", head & ~F.col("_sel"))
    x = x.withColumn("_has_hdr", F.max(F.col("_hdr_row").cast("int")).over(wd) == 1)
    rk = F.when(F.col("_hdr_row"), F.lit(None)).otherwise(F.coalesce("data_row", F.lit("0")))
    x = x.withColumn("_rk", rk)
    r = F.dense_rank().over(Window.partitionBy("doc_id", "_hdr_row").orderBy(
        F.asc_nulls_last(num(F.col("_rk"))), F.col("_rk")))
    x = x.withColumn("r", F.when(F.col("_hdr_row"), F.lit(0))
                     .otherwise(r - 1 + F.col("_has_hdr").cast("int")).cast("int"))
    c = F.row_number().over(Window.partitionBy("doc_id", "r").orderBy(F.asc_nulls_last(num(F.col("data_col"))),
                                                                      F.col("el_pos")))
    return x.select("doc_id", "r", (c - 1).cast("int").alias("c"), "is_header", "text",
                    F.col("data_row"), F.col("data_col"))


# ---------------------------------------------------------------------------------------------------------------
# F1 selection overlap, E3 ARIA rows -> table, B7/B8 grid renderings

def mark_selected(elements: DataFrame, selections: DataFrame) -> DataFrame:
    """an element (``pos``..``end_pos``) is selected when it overlaps any selection range of its document: one that begins
    before it and reaches it, or one that begins inside it. Elements and ranges are one relation in document order, so a
    running maximum of range ends and the next range's start answer both; no join."""
    cols = elements.columns
    e = elements.select("doc_id", F.col("pos").alias("_p"), F.struct(*cols).alias("_e"), F.lit(None).cast("long").alias("_end"))
    r = selections.select("doc_id", F.col("start_pos").alias("_p"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"), F.col("end_pos").cast("long").alias("_end"))
    w = Window.partitionBy("doc_id").orderBy("_p", F.col("_e").isNotNull())
    u = e.unionByName(r).withColumns({
        "_reach": F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.min(F.when(F.col("_e").isNull(), F.col("_p"))).over(w.rowsBetween(1, Window.unboundedFollowing))})
    hit = F.coalesce(F.col("_reach") >= F.col("_e.pos"), F.lit(False)) | F.coalesce(F.col("_next") <= F.col("_e.end_pos"), F.lit(False))
    return u.filter(F.col("_e").isNotNull()).select(*[F.col("_e")[c].alias(c) for c in cols], hit.alias("selected"))


def aria_row_cells(tree: DataFrame) -> DataFrame:
    """E3 input: documents with ARIA rows and no ``<table>``; each ``role=row`` becomes a row whose cells are the
    role cells inside it (``cell``/``columnheader``/``gridcell``), or - when it has none - its element children;
    a row with a ``columnheader`` is a header row. Needs ``with_tree``."""
    from .nodes import running
    kind, tag = F.col("kind"), F.col("tag")
    mo = (kind == "open") & F.col("matched")
    mc = (kind == "close") & F.col("matched")
    is_row = _role() == "row"
    wd = Window.partitionBy("doc_id")
    n = (tree.withColumn("_has_table", F.max(((tag == "table") & (kind == "open")).cast("int")).over(wd) == 1)
             .withColumn("_has_rows", F.max((is_row & mo).cast("int")).over(wd) == 1)
             .filter(F.col("_has_rows") & ~F.col("_has_table"))
             .withColumn("_wd", F.sum(F.when(is_row & mo, 1).when(is_row & mc, -1).otherwise(0)).over(running()))
             .withColumn("row_pos", F.last(F.when(is_row & mo, F.col("pos")), ignorenulls=True).over(running())))
    role_cell = _role().isin(ARIA_ROW_CELL_ROLES) & (F.col("_wd") > 0)
    n = n.withColumn("_row_has_cells", F.max(role_cell.cast("int")).over(Window.partitionBy("doc_id", "row_pos")) == 1)
    child_cell = (F.col("_wd") > 0) & ~F.col("_row_has_cells") & kind.isin("open", "close") & F.col("matched") \
        & (F.col("parent_pos") == F.col("row_pos"))
    cells = element_texts(n, role_cell | child_cell, {
        "row_pos": F.col("row_pos"), "is_header": _role() == "columnheader"})
    w_row = Window.partitionBy("doc_id", "row_pos")
    cells = cells.withColumn("header_row", F.max(F.col("is_header").cast("int")).over(w_row) == 1)
    return cells.select("doc_id", "row_pos", "el_pos", "is_header", "header_row", "text")


def esc_html(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit(" "), F.lit("&nbsp;"))


def rows_to_table_html(cells: DataFrame, row_key: str, cell_key: str, header_row: str, header_cell: str,
                       group: tuple = ("doc_id",)) -> DataFrame:
    """Cells -> one ``<table>`` per ``group``: header rows (in order) in ``thead``, the rest in ``tbody``; header
    cells as ``th``. One aggregate per row, one per table."""
    group = list(group)
    cell = F.concat(F.when(F.col(header_cell), F.lit("<th>")).otherwise(F.lit("<td>")), esc_html(F.col("text")),
                    F.when(F.col(header_cell), F.lit("</th>")).otherwise(F.lit("</td>")))
    rows = (cells.groupBy(*group, row_key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(cell_key).alias("k"), cell.alias("v")))),
                                 lambda s: s["v"]), "").alias("tds"),
        F.max(F.col(header_row).cast("int")).alias("hdr")))
    tr = F.concat(F.lit("<tr>"), F.col("tds"), F.lit("</tr>"))
    doc = rows.groupBy(*group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hdr") == 1, F.struct(
            F.col(row_key).alias("k"), tr.alias("v"))))), lambda s: s["v"]), "").alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hdr") == 0, F.struct(
            F.col(row_key).alias("k"), tr.alias("v"))))), lambda s: s["v"]), "").alias("body"))
    return doc.select(*group, F.concat(
        F.lit("<table>"), F.when(F.col("head") != "", F.concat(F.lit("<thead>"), F.col("head"), F.lit("</thead>")))
        .otherwise(F.lit("")), F.lit("<tbody>"), F.col("body"), F.lit("</tbody></table>")).alias("table_html"))


def grid_markdown(grid: DataFrame) -> DataFrame:
    """First grid table of each document as GFM (first row is the heading row; K12)."""
    return cells_to_markdown(grid.filter(F.col("table_no") == 0)).select("doc_id", "markdown")


def grid_simple_html(grid: DataFrame) -> DataFrame:
    """First grid table as Simple HTML: the first row is the header row (promoted when the grid had none)."""
    g = grid.filter(F.col("table_no") == 0).withColumn("_h", F.col("r") == 0)
    return rows_to_table_html(g, "r", "c", "_h", "_h").withColumnRenamed("table_html", "simple_html")
