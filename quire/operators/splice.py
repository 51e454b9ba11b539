"""Tokens that are made, moved or replaced (E3 inside the conversion, F2, F3).

A stage gives every token it keeps or makes a place ``(anchor, section, edge, pos)``: an untouched token has its own position
as anchor, tokens that belong to a rebuilt or swapped table share the position where that table goes. One ``row_number`` over
the places numbers the document anew; documents in which nothing fires keep their positions. All windows are
partitioned by ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import ARIA_ROW_CELL_ROLES
from ..session import ensure_checkpoint_dir
from .nodes import classify, clean_markup, following, markup_size, role, running, tasks_for, total_size, with_closest, with_spans, TOKEN_RE
from .render_html import escape_text

BASE = ["doc_id", "pos", "kind", "tag", "text", "attrs", "before"]
TOKEN = "struct<kind:string,tag:string,text:string,attrs:map<string,string>,before:string,a:int,s:int,e:int>"
#: Sections of a rebuilt table, in order.
TABLE_OPEN, HEAD, BODY, TABLE_CLOSE = 1, 2, 3, 4


def token(kind, tag, anchor: Column, section, edge: int, text=None, attrs=None, before=None) -> Column:
    """A token and its place but for its position; ``kind`` and ``tag`` may be names or columns."""
    col = lambda c: F.lit(c) if c is None or isinstance(c, (str, int)) else c
    made = F.create_map().cast("map<string,string>") if attrs is None and not isinstance(kind, Column) and kind != "close" else F.lit(None) if attrs is None else attrs
    return F.struct(col(kind).alias("kind"), col(tag).alias("tag"), col(text).alias("text"), made.alias("attrs"), col(before).alias("before"),
                    anchor.alias("a"), col(section).alias("s"), F.lit(edge).alias("e")).cast(TOKEN)


def itself(anchor: Column, section, edge: int) -> Column:
    return token(F.col("kind"), F.col("tag"), anchor, section, edge, F.col("text"), F.col("attrs"), F.col("before"))


def renumbered(n: DataFrame, tokens: Column, changed: Column) -> DataFrame:
    """The tokens of each row in the order of their places, with spans. The document's marker stays at -1."""
    x = n.select("doc_id", "pos", changed.alias("_changed"), F.posexplode(tokens).alias("_i", "_t"))
    w = Window.partitionBy("doc_id").orderBy("_t.a", "_t.s", "_t.e", "pos", "_i")
    x = x.withColumn("_pos", (F.row_number().over(w) - 2).cast("int"))
    return with_spans(x.select("doc_id", F.when(F.col("_changed"), F.col("_pos")).otherwise(F.col("pos")).alias("pos"),
                               *[F.col("_t")[c].alias(c) for c in BASE[2:]]))


def rebuild_aria_rows(spans: DataFrame, label: str) -> DataFrame:
    """In a document with ARIA rows and no ``table`` the rows become one table, where the first of them stands. A row's
    cells are the elements with a cell role inside it, or its element children if there are none; cells keep their markup, a
    ``columnheader`` is ``th``, and rows with one stand in ``thead``. What a row holds outside its cells goes. A row
    inside a row, and a cell inside a cell, is markup of the outer one. The document's marker gets ``label`` as the attribute
    ``source_type``."""
    kind, tag = F.col("kind"), F.col("tag")
    mo, mc = (kind == "open") & F.col("matched"), (kind == "close") & F.col("matched")
    is_row, is_cell = role() == "row", role().isin(ARIA_ROW_CELL_ROLES)

    def depth(el: Column) -> Column:
        return F.sum(F.when(el & mo, 1).when(el & mc, -1).otherwise(0)).over(running())

    n = spans.withColumns({"_d": depth(F.lit(True)), "_rows": depth(is_row)})
    opens, closes, inside = is_row & mo & (F.col("_rows") == 1), is_row & mc & (F.col("_rows") == 0), F.col("_rows") > 0
    n = n.withColumns({"_row": F.last(F.when(opens, F.struct("pos", "_d")), ignorenulls=True).over(running()),
                       "_cells": depth(is_cell & inside)})
    n = n.withColumn("_row_pos", F.when(inside | closes, F.col("_row.pos")))
    in_row, by_doc = F.col("_row_pos").isNotNull(), Window.partitionBy("doc_id")
    # rows stand one after the other, so a token's row holds a cell if the last or the next one is in the same row
    n = n.withColumns({"_cell_row": F.when(in_row & inside & is_cell & mo, F.col("_row_pos")),
                       "_head_row": F.when(in_row & inside & mo & (role() == "columnheader"), F.col("_row_pos"))})
    n = n.withColumns({f"{c}_{k}": v for c in ("_cell_row", "_head_row") for k, v in (("last", F.last(c, ignorenulls=True).over(running())), ("next", following(c)))}
                      | {"_first": F.min(F.when(opens, F.col("pos"))).over(by_doc), "_thead": F.max(F.col("_head_row").isNotNull()).over(by_doc),
                         "_table": F.max((tag == "table") & (kind == "open")).over(by_doc)})
    n = n.withColumns({name: F.coalesce(F.col(f"{c}_last") == F.col("_row_pos"), F.lit(False)) | F.coalesce(F.col(f"{c}_next") == F.col("_row_pos"), F.lit(False))
                       for name, c in (("_by_role", "_cell_row"), ("_header", "_head_row"))})
    fires = F.col("_first").isNotNull() & ~F.coalesce("_table", F.lit(False))
    at, d = F.col("_first"), F.col("_row._d")
    section = F.when(F.col("_header"), HEAD).otherwise(BODY)
    made = lambda k, t, s, e: token(k, t, at, s, e)
    frame = F.array(made("open", "table", TABLE_OPEN, 0), made("open", "tbody", BODY, 0), made("close", "tbody", BODY, 2), made("close", "table", TABLE_CLOSE, 0))
    head = F.when(F.col("_thead"), F.array(made("open", "thead", HEAD, 0), made("close", "thead", HEAD, 2))).otherwise(F.array().cast(f"array<{TOKEN}>"))
    name = F.when(F.col("_by_role") & (role() == "columnheader"), "th").otherwise("td")
    child = F.col("_by_role") == F.lit(False)
    cell_open = mo & F.when(child, F.col("_d") == d + 1).otherwise(is_cell & (F.col("_cells") == 1))
    cell_close = mc & F.when(child, F.col("_d") == d).otherwise(is_cell & (F.col("_cells") == 0))
    content = F.when(child, F.when(mo, F.col("_d") > d + 1).otherwise(F.col("_d") > d)).otherwise(F.col("_cells") > 0)
    tr = made("open", "tr", section, 1)
    row_tokens = (
        F.when(opens, F.when(F.col("pos") == at, F.concat(frame, head, F.array(tr))).otherwise(F.array(tr)))
         .when(closes, F.array(made("close", "tr", section, 1)))
         .when(cell_open, F.array(token(F.lit("open"), name, at, section, 1, attrs=F.create_map().cast("map<string,string>"))))
         .when(cell_close, F.array(token("close", name, at, section, 1)))
         .when(child & (kind == "void") & (F.col("_d") == d), F.array(made("open", "td", section, 1), made("close", "td", section, 1)))
         .when(content, F.array(itself(at, section, 1)))
         .otherwise(F.array().cast(f"array<{TOKEN}>")))
    facts = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: k != "source_type")
    marker = token(kind, tag, F.col("pos"), 0, 0, F.col("text"), F.map_concat(facts, F.create_map(F.lit("source_type"), F.lit(label))), F.col("before"))
    tokens = (F.when((kind == "doc") & fires, F.array(marker))
               .when(fires & in_row, row_tokens)
               .otherwise(F.array(itself(F.col("pos"), 0, 0))))
    return renumbered(n, tokens, fires)


# ---------------------------------------------------------------------------------------------------------------
# F2 / F3

def grid_tables(cells: DataFrame) -> DataFrame:
    """The grids of each document as ``(doc_id, grid_type, tables array<struct<table_no, width, html>>)``, from
    ``cells(doc_id, table_no, r, c, is_header, strategy)`` with ``html`` or ``text``. The cells of a native grid keep their
    tags; in other grids the rows with a header cell stand in ``thead``, the first row if there is none."""
    content = F.col("html") if "html" in cells.columns else escape_text(F.col("text"))
    name = F.when(F.col("is_header"), "th").otherwise("td")
    native = F.col("strategy") == "native"
    keys = ["doc_id", "strategy", "table_no"]
    first = (cells.groupBy(*keys, "r").agg(
        F.array_sort(F.collect_list(F.struct("c", name.alias("n"), F.coalesce(content, F.lit("")).alias("v")))).alias("cs"), F.max("is_header").alias("h")))
    w = Window.partitionBy(*keys)
    first = first.withColumns({"_any": F.max("h").over(w), "_r0": F.min("r").over(w)})
    promoted = ~native & ~F.col("_any") & (F.col("r") == F.col("_r0"))
    tag_of = lambda c: F.when(promoted, F.lit("th")).otherwise(c["n"])
    tr = F.concat(F.lit("<tr>"), F.array_join(F.transform("cs", lambda c: F.concat(F.lit("<"), tag_of(c), F.lit(">"), c["v"], F.lit("</"), tag_of(c), F.lit(">"))), ""), F.lit("</tr>"))
    rows = first.select(*keys, "r", (~native & (F.col("h") | promoted)).alias("h"), tr.alias("tr"), F.size("cs").alias("n"), "_r0")
    part = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("r", "tr")))), lambda x: x["tr"]), "")
    tables = rows.groupBy(*keys).agg(part(F.col("h")).alias("head"), part(~F.col("h")).alias("body"), F.max(F.when(F.col("r") == F.col("_r0"), F.col("n"))).alias("width"))
    html = F.concat(F.lit("<table>"), F.when(F.col("head") != "", F.concat(F.lit("<thead>"), F.col("head"), F.lit("</thead>"))).otherwise(""),
                    F.when(native, F.col("body")).otherwise(F.concat(F.lit("<tbody>"), F.col("body"), F.lit("</tbody>"))), F.lit("</table>"))
    return tables.groupBy("doc_id").agg(F.min("strategy").alias("grid_type"), F.array_sort(F.collect_list(F.struct(
        F.col("table_no").cast("int").alias("table_no"), F.col("width").cast("int").alias("width"), html.alias("html")))).alias("tables"))


def with_grids(payloads: DataFrame, grids: DataFrame, html_col: str = "html") -> tuple[DataFrame, int]:
    """``payloads`` with the grids of their document, and the number of tasks that the tokens of both ask for. The grids are
    kept in the checkpoint folder, so that counting them doesn't make them twice."""
    ensure_checkpoint_dir(grids.sparkSession)
    grids = grids.checkpoint()
    size = total_size(payloads, markup_size(F.col(html_col)))
    size += total_size(grids, F.aggregate("tables", F.lit(0.0), lambda n, t: n + markup_size(t["html"])))
    return payloads.join(grids, "doc_id", "left"), tasks_for(size)


def spliced_nodes(payloads: DataFrame, tasks: int) -> DataFrame:
    """Tokens of ``payloads(doc_id, html, grid_type, tables)``, one row for each document, after F2 and F3, with ``before``. A map column
    ``facts`` becomes the attributes of the document's marker. ``tasks`` is what :func:`with_grids` says.

    F2: native grids replace the tables of the payload, the i-th the i-th, if there are as many and none of the payload's
    is more than twice as wide as the first row of its grid (a layout table). F3: other grids become the whole body of a
    payload without a table. Payload and grid are one relation of tokens; the grid's tokens move to their table's place."""
    p = payloads.repartition(tasks, "doc_id")
    tok = lambda html: F.regexp_extract_all(html, F.lit(TOKEN_RE), 0)
    item = lambda t, g, w: F.struct(t.alias("tok"), g.cast("int").alias("grid"), w.cast("int").alias("width"))
    none = F.lit(None)
    grids = F.flatten(F.transform("tables", lambda t, i: F.transform(tok(t["html"]), lambda x: item(x, i, t["width"]))))
    kind_of = "array<struct<tok:string,grid:int,width:int>>"
    own = F.transform(F.coalesce(tok(clean_markup(F.col("html"), implied=True)), F.array().cast("array<string>")), lambda x: item(x, none, none))
    toks = F.concat(F.array(item(F.lit(""), none, none)), own.cast(kind_of), F.coalesce(grids, F.array().cast(kind_of)).cast(kind_of))
    facts = F.col("facts") if "facts" in payloads.columns else F.lit(None).cast("map<string,string>")
    n = p.select("doc_id", F.col("grid_type"), F.coalesce(F.size("tables"), F.lit(0)).alias("n_grids"), facts.alias("facts"), F.posexplode(toks).alias("pos", "t"))
    n = n.select("doc_id", (F.col("pos") - 1).alias("pos"), F.when(F.col("n_grids") > 0, F.col("grid_type")).alias("grid_type"), "n_grids", "t.tok", "t.grid", "t.width",
                 F.when(F.col("pos") == 0, F.col("facts")).alias("facts"))
    n = classify(n).drop("tok").withColumns({"before": F.lit(None).cast("string"), "attrs": F.coalesce("facts", "attrs")}).drop("facts")
    n = with_spans(n)
    kind, tag, grid = F.col("kind"), F.col("tag"), F.col("grid")
    mine = grid.isNull()
    opens = (tag == "table") & (kind == "open") & mine
    n = n.withColumn("_no", F.when(mine, F.sum(opens.cast("int")).over(running()) - 1).otherwise(grid))
    n = with_closest(n, _table=(tag == "table") & mine, _tr=(tag == "tr") & mine)
    is_cell = tag.isin("td", "th") & (kind == "open")
    n = n.withColumn("_row_width", F.sum(is_cell.cast("int")).over(Window.partitionBy("doc_id", "_tr")))
    n = n.withColumn("_clip", F.max(F.when((tag == "tr") & (kind == "open"), F.col("_row_width"))).over(Window.partitionBy("doc_id", "_table")))
    # a table of the payload meets the grid of its number; tables inside a table go with it
    outer = opens & F.col("matched")
    n = n.withColumn("_up", F.sum(F.when(outer, 1).when((tag == "table") & (kind == "close") & F.col("matched") & mine, -1).otherwise(0)).over(running()))
    number = Window.partitionBy("doc_id", "_no")
    n = n.withColumns({"_width": F.max("width").over(number), "_place": F.max(F.when(outer & (F.col("_up") == 1), F.col("pos"))).over(number),
                       "_widest": F.max(F.when(opens, F.col("_clip"))).over(number)})
    layout = opens & (F.col("_width") > 0) & (F.coalesce("_widest", F.lit(0)) > F.col("_width") * 2)
    doc = Window.partitionBy("doc_id")
    n = n.withColumns({"_n": F.sum(opens.cast("int")).over(doc), "_bad": F.max(layout).over(doc)})
    swap = F.coalesce((F.col("grid_type") == "native") & (F.col("_n") > 0) & (F.col("_n") == F.col("n_grids")) & ~F.col("_bad"), F.lit(False))
    inject = F.coalesce((F.col("grid_type") != "native") & (F.col("_n") == 0), F.lit(False))
    in_table = (F.col("_up") > 0) | ((tag == "table") & (kind == "close") & F.col("matched"))
    stays = mine & ((kind == "doc") | ~(inject | (swap & in_table)))
    moves = ~mine & (inject | (swap & F.col("_place").isNotNull()))
    place = F.when(inject, 0).otherwise(F.col("_place"))
    tokens = F.when(stays, F.array(itself(F.col("pos"), 0, 0))).when(moves, F.array(itself(place, 1, 0))).otherwise(F.array().cast(f"array<{TOKEN}>"))
    return renumbered(n, tokens, swap | inject).select(*BASE)
