"""The two equivalents of an HTML payload, as staged DataFrame transforms.

Stage order (the reference's): grids first (F2, F3), then the repairs - E1 cell divs, D10 fake bold, D8/D9 beacons,
E2 image sizes, E3 ARIA rows - then, on one relation for both outputs, D1/D3 sanitize, E7 naming and the collapse D11/D12/D13.
There the outputs part: the renderer reads the tokens for Markdown, and the pieces of the Simple HTML (E6, C6) travel
with them to the same aggregates, so both come from one pass. Spans are re-derived only where a stage rewrote tags
and the tree where a later stage asks for siblings or parents of survivors. Every re-derivation is a window over the same
``doc_id`` partitioning: no extra exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repair as RP
from .entries import DERIVED_HTML, SOURCE_ARIA, SOURCE_HTML, SOURCE_TSV, blank_to_empty, hotkey_route
from .nodes import markup_size, tasks_for, to_nodes, total_size, with_spans, with_tree
from .policy import sanitize
from .render_html import to_html, token_html
from .splice import rebuild_aria_rows, spliced_nodes, with_grids

BASE = ["doc_id", "pos", "kind", "tag", "text", "attrs", "before"]


def base(n: DataFrame) -> DataFrame:
    return n.select(*BASE)


def respan(n: DataFrame) -> DataFrame:
    return with_spans(base(n))


def source_nodes(payloads: DataFrame, html_col: str = "html", facts_col: str | None = None) -> DataFrame:
    """Tokens of the payloads, with ``before``. A map column of facts becomes the attributes of the document's marker."""
    n = to_nodes(payloads, "doc_id", html_col, doc_marker=True, facts_col=facts_col, implied=True)
    return n.withColumn("before", F.lit(None).cast("string"))


def repaired(payloads: DataFrame, html_col: str = "html", upto: str = "e3", nodes: DataFrame | None = None) -> DataFrame:
    """The source repairs, in order; ``upto`` stops early (for the per-stage queries). Output has spans; where E3 fired the
    document's marker has the lineage label as its attribute ``source_type``."""
    t = with_tree(RP.in_cells(with_spans(source_nodes(payloads, html_col) if nodes is None else nodes)))
    s = respan(RP.inline_cell_divs(t))
    if upto == "e1":
        return s
    s = RP.unwrap_fake_bold(s)
    if upto == "d10":
        return s
    s = RP.drop_invisible_images(s)
    if upto == "d9":
        return s
    s = RP.transcribe_image_size(s)
    if upto == "e2":
        return s
    return rebuild_aria_rows(s, SOURCE_ARIA)


def simple_html_nodes(payloads: DataFrame, html_col: str = "html", upto: str = "e6",
                      rep: DataFrame | None = None) -> DataFrame:
    """Simple HTML branch on the repaired nodes (``rep`` when already computed); ``upto`` in
    sanitize/e7/d11/d12/d13/e6."""
    s = sanitize(rep if rep is not None else repaired(payloads, html_col))
    if upto == "sanitize":
        return s
    s = RP.name_empty_links_and_images(s)
    if upto == "e7":
        return s
    s = RP.drop_empty_containers(s)
    if upto == "d11":
        return s
    s = RP.unwrap_single_child_divs(with_tree(s))
    if upto == "d12":
        return s
    s = RP.drop_dead_whitespace(s)
    if upto == "d13":
        return s
    return RP.simplify_tables(with_tree(RP.nested_in_tables(respan(s))))


def markdown_nodes(payloads: DataFrame, html_col: str = "html", rep: DataFrame | None = None) -> DataFrame:
    """Markdown branch: repaired -> sanitize -> E7 naming -> tree. Header promotion (E5) happens where the
    renderer assembles tables; container collapse changes nothing the renderer emits (empty blocks vanish)."""
    r = rep if rep is not None else repaired(payloads, html_col)
    return with_tree(RP.name_empty_links_and_images(sanitize(r)), items=True)


def to_markdown(payloads: DataFrame, html_col: str = "html") -> DataFrame:
    """``(doc_id, markdown)`` for every payload row."""
    from .render_md import render_markdown
    return render_markdown(markdown_nodes(payloads, html_col))


def entries_of(nodes: DataFrame, cut: int | None = None) -> DataFrame:
    """Both equivalents from tokens (``BASE``), in one pass: ``(doc_id, markdown, simple_html, facts)``; ``facts`` are the
    attributes of the document's marker, with the lineage of a rebuilt table. Every sort of a stage takes a page of memory, however
    few rows it has: with ``cut``, the tasks of tokens and grids, an exchange by document divides the sorts between two stages. It has one
    partition more, for Spark leaves out an exchange to the partitions that are already there."""
    from .render_md import render_markdown
    s = sanitize(repaired(None, nodes=nodes))
    s = RP.name_empty_links_and_images(s.repartition(cut + 1, "doc_id") if cut else s)
    s = RP.unwrap_single_child_divs(with_tree(RP.drop_empty_containers(s)))
    t = with_tree(RP.nested_in_tables(respan(RP.drop_dead_whitespace(s))), items=True)
    h = RP.with_simplified_tables(t)
    piece = F.concat(F.coalesce(escape_before(), F.lit("")), token_html(F.col("kind"), F.col("tag"), F.col("attrs"), F.col("text"), F.col("matched")))
    h = h.withColumn("_html", F.when(F.col("_tidied"), F.lit("")).otherwise(piece)).drop("_tidied")
    out = render_markdown(h, html_col="_html")
    return out.withColumn("simple_html", blank_to_empty(F.col("simple_html")))


def escape_before():
    from .render_html import escape_text
    return escape_text(F.col("before"))


def to_entries(payloads: DataFrame, html_col: str = "html", grids: DataFrame | None = None) -> DataFrame:
    """``(doc_id, markdown, simple_html, derived_from, source_type)`` of every payload row. ``grids``
    (``splice.grid_tables``) are the tables of the page: they replace the payload's or stand in for them (F2, F3)."""
    if grids is None:
        out = entries_of(source_nodes(payloads, html_col))
    else:
        p, tasks = with_grids(payloads.select("doc_id", F.col(html_col).alias("html")), grids)
        out = entries_of(spliced_nodes(p, tasks), cut=tasks)
    return out.select("doc_id", "markdown", "simple_html", F.lit(DERIVED_HTML).alias("derived_from"),
                      F.coalesce(F.col("facts")["source_type"], F.lit(SOURCE_HTML)).alias("source_type"))


def route_entries(payloads: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """The entries of mixed payloads ``(doc_id, html, plain)`` in one job: ``route``, ``markdown``, ``simple_html`` and
    ``source_type``. HTML goes through the conversion; without it a grid of the page that is no native table does; TSV and other
    plain text are done by column functions and travel as facts of the document's marker. The payloads are read once."""
    from ..functions.tsv import tsv_to_html, tsv_to_markdown
    none = F.lit(None)
    p = payloads.select("doc_id", "html", "plain")
    if grids is not None:
        p, tasks = with_grids(p, grids)
    else:
        tasks = tasks_for(total_size(p, markup_size(F.col("html"))))
        p = p.withColumns({"grid_type": none.cast("string"), "tables": none.cast("array<struct<table_no:int,width:int,html:string>>")})
    has_grid = F.coalesce(F.col("grid_type") != "native", F.lit(False)) & F.col("plain").isNotNull()
    p = p.withColumn("route", hotkey_route(F.col("html"), F.col("plain"), has_grid))
    r = F.col("route")
    facts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("route", "markdown", "simple_html", "source_type"))), F.array(
        r, F.when(r == "tsv", tsv_to_markdown(F.col("plain"))).when(r == "plain", F.col("plain")),
        F.when(r == "tsv", tsv_to_html(F.col("plain"))).when(r == "plain", F.lit("")),
        F.when(r == "html", F.lit(SOURCE_HTML)).when(r == "grid", F.lit(SOURCE_ARIA)).when(r == "tsv", F.lit(SOURCE_TSV)).when(r == "plain", F.lit("Plain Text")))),
        lambda k, v: v.isNotNull())
    p = p.withColumns({"facts": facts, "html": F.when(r == "html", F.col("html"))})
    used = r.isin("html", "grid")
    p = p.withColumns({"grid_type": F.when(used, F.col("grid_type")), "tables": F.when(r == "grid", F.slice("tables", 1, 1)).when(used, F.col("tables"))})
    out = entries_of(spliced_nodes(p, tasks), cut=tasks if grids is not None else None)
    fact = lambda k: F.col("facts")[k]
    return out.select("doc_id", fact("route").alias("route"), F.coalesce(fact("markdown"), F.col("markdown")).alias("markdown"),
                      F.coalesce(fact("simple_html"), F.col("simple_html")).alias("simple_html"), fact("source_type").alias("source_type"))


def to_simple_html(payloads: DataFrame, html_col: str = "html", upto: str = "e6") -> DataFrame:
    """``(doc_id, simple_html)`` for every payload row."""
    out = to_html(simple_html_nodes(payloads, html_col, upto), out_col="simple_html")
    return out.withColumn("simple_html", blank_to_empty(F.col("simple_html")))
