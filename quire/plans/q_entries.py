"""The entries job over tables, grids and mixed payloads (B3, B9, E3, F2, F3, F5, F6, J4, K13): documents built from
``supplier`` whose oracles state the expected text itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive as DV
from ..operators import grid as G
from ..operators import rules as RU
from ..operators.compare import dedup_entries
from ..operators.nodes import role, to_nodes, with_closest, with_spans, with_tree
from ..operators.render_md import render_markdown
from ..operators.splice import grid_tables
from ..sources.tables import load_table
from .q_blocks import documents, expected
from .q_markdown import markdown_of
from .registry import query


def filled(*lines: str) -> str:
    """SQL for a text with the marks ``{name}`` and ``{key}``, line by line."""
    text = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in lines)
    return f"replace(replace({text}, '{{name}}', s_name), '{{key}}', CAST(s_suppkey AS VARCHAR))"


def stated(where: str = "", **columns) -> str:
    """SQL for one row of each supplier; a column is its lines or ready SQL."""
    cols = ", ".join(f"{v if isinstance(v, str) else filled(*v)} AS {k}" for k, v in columns.items())
    return f"SELECT CAST(s_suppkey AS BIGINT) AS doc_id, {cols} FROM supplier{' WHERE ' + where if where else ''}"


def tree(payloads: DataFrame) -> DataFrame:
    return with_tree(with_spans(to_nodes(payloads)))


# ---------------------------------------------------------------------------------------------------------------
# E3 inside the conversion

ARIA = ('<p>Before {key}</p><div role="grid">', '<div role="row"><span role="columnheader">Name</span> <span role="columnheader">Role</span></div>\n',
        '<div role="rowgroup"><div role="row"><span role="gridcell">{name}</span>, <span role="gridcell"><b>{key}</b></span></div></div></div><p>after</p>')


@query("e3_entries", oracle=lambda: stated(
    markdown=["Before {key}", "", "| Name | Role |", "| --- | --- |", "| {name} | **{key}** |", "", "after"],
    simple_html=["<p>Before {key}</p><div><table><thead><tr><th>Name</th><th>Role</th></tr></thead><tbody><tr><td>{name}</td><td><b>{key}</b></td></tr></tbody></table></div><p>after</p>"],
    derived_from="'text/html'", source_type="'HTML (Extracted ARIA Table)'"))
def e3_entries(spark: SparkSession, sf: str) -> DataFrame:
    """ARIA rows become a table of both outputs, cells keep their markup, the lineage says so."""
    return DV.to_entries(documents(spark, sf, *ARIA))


@query("e3_children", oracle=lambda: stated(
    markdown=["| {name} | {key} |  |", "| --- | --- | --- |", "| b | c |"],
    simple_html=["<table><tr><td>{name}</td><td><i>{key}</i></td><td></td></tr><tr><td>b</td><td>c</td></tr></table>"], derived_from="'text/html'", source_type="'HTML (Extracted ARIA Table)'"))
def e3_children(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without cell roles have their element children as cells; no header row is made in the Simple HTML."""
    return DV.to_entries(documents(spark, sf, '<div role="row">loose<span>{name}</span><div><i>{key}</i></div><br></div>', '<div role="row"><span>b</span><span>c</span></div>'))


# ---------------------------------------------------------------------------------------------------------------
# Grids of the page in the entries job

PAYLOAD = ("<p>x {key}</p><table><tr><td>{name}</td><td>jagged</td></tr><tr><td>only</td></tr></table><p>mid</p>", "<table><tr><td>b</td></tr></table><p>end</p>")
PAGE = ('<table><tr><th>N</th><th>L</th></tr><tr><td>{name}</td><td><a href="u{key}">go <b>on</b></a></td></tr></table>', "<table><tr><td>1</td><td>{key}</td></tr><tr><td>3</td><td>4</td></tr></table>")


def native_grids(pages: DataFrame) -> DataFrame:
    return grid_tables(G.native_cells(tree(pages)).withColumn("strategy", F.lit("native")))


@query("f2_entries", oracle=lambda: stated(
    markdown=["x {key}", "", "| N | L |", "| --- | --- |", "| {name} | [go **on**](u{key}) |", "", "mid", "", "| 1 | {key} |", "| --- | --- |", "| 3 | 4 |", "", "end"],
    simple_html=['<p>x {key}</p><table><tr><th>N</th><th>L</th></tr><tr><td>{name}</td><td><a href="u{key}">go <b>on</b></a></td></tr></table><p>mid</p><table><tr><td>1</td><td>{key}</td></tr><tr><td>3</td><td>4</td></tr></table><p>end</p>'],
    derived_from="'text/html'", source_type="'HTML'"))
def f2_entries(spark: SparkSession, sf: str) -> DataFrame:
    """F2 in B3: the page's native tables replace the payload's, the first the first and so on, with their markup."""
    return DV.to_entries(documents(spark, sf, *PAYLOAD), grids=native_grids(documents(spark, sf, *PAGE)))


@query("f2_entries_guarded", oracle=lambda: stated(
    markdown=["| a | b | c | d | {key} |", "| --- | --- | --- | --- | --- |", "| {name} |"],
    simple_html=["<table><tr><td>a</td><td>b</td><td>c</td><td>d</td><td>{key}</td></tr><tr><td>{name}</td></tr></table>"], derived_from="'text/html'", source_type="'HTML'"))
def f2_entries_guarded(spark: SparkSession, sf: str) -> DataFrame:
    """A payload table more than twice as wide as its grid is a layout table; the payload stays as it is."""
    payload = documents(spark, sf, "<table><tr><td>a</td><td>b</td><td>c</td><td>d</td><td>{key}</td></tr><tr><td>{name}</td></tr></table>")
    return DV.to_entries(payload, grids=native_grids(documents(spark, sf, "<table><tr><td>{key}</td><td>2</td></tr></table>")))


SELECTED = ('<div role="grid"><div role="row"><span role="columnheader">K</span><span role="columnheader" aria-selected="true">N</span></div>',
            '<div role="row"><span role="gridcell" aria-selected="true">{key}</span><span role="gridcell"><b>{name}</b></span></div></div>')


def aria_grids(pages: DataFrame) -> DataFrame:
    return grid_tables(G.repair_grid(G.first_root(G.aria_cells(tree(pages)))))


@query("f3_entries", oracle=lambda: stated(
    markdown=["|  | N |", "| --- | --- |", "| {key} |  |"],
    simple_html=["<table><thead><tr><th></th><th>N</th></tr></thead><tbody><tr><td>{key}</td><td></td></tr></tbody></table>"], derived_from="'text/html'", source_type="'HTML'"))
def f3_entries(spark: SparkSession, sf: str) -> DataFrame:
    """F3 in B3: a payload without a table has the page's ARIA grid as its whole body; unselected cells are empty."""
    return DV.to_entries(documents(spark, sf, "<p>{name}{key} lost</p>"), grids=aria_grids(documents(spark, sf, *SELECTED)))


# ---------------------------------------------------------------------------------------------------------------
# One job for all routes

def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    """HTML, grid, TSV, plain text, nothing: by ``s_suppkey % 5``."""
    d = documents(spark, sf, "<p>{name} <b>{key}</b></p>")
    k, text = F.col("doc_id") % 5, F.regexp_extract("html", "<p>(.*) <b>", 1)
    plain = F.when(k == 2, F.concat(F.lit("key\tname\n"), F.col("doc_id").cast("string"), F.lit("\t"), text)).when(k < 4, F.concat(text, F.lit(" plain")))
    return d.select("doc_id", F.when(k == 0, F.col("html")).alias("html"), plain.alias("plain"))


def _d_routes() -> str:
    def row(k, route, md, sh, source):
        return stated(f"s_suppkey % 5 = {k}", route=f"'{route}'", markdown=md, simple_html=sh, source_type=source)

    tsv_md = ["| key | name |", "| --- | --- |", "| {key} | {name} |", ""]
    tsv_html = ["<table>", "<thead>", "<tr>", '<th style="font-weight: normal;">key</th>', '<th style="font-weight: normal;">name</th>', "</tr>", "</thead>", "<tbody>", "<tr>",
                "<td>{key}</td>", "<td>{name}</td>", "</tr>", "</tbody>", "</table>", ""]
    return " UNION ALL ".join([
        row(0, "html", ["{name} **{key}**"], ["<p>{name} <b>{key}</b></p>"], "'HTML'"),
        row(1, "grid", ["|  | N |", "| --- | --- |", "| {key} |  |"], ["<table><thead><tr><th></th><th>N</th></tr></thead><tbody><tr><td>{key}</td><td></td></tr></tbody></table>"], "'HTML (Extracted ARIA Table)'"),
        row(2, "tsv", tsv_md, tsv_html, "'Plain Text (TSV Conversion)'"),
        row(3, "plain", ["{name} plain"], "''", "'Plain Text'"),
        row(4, "none", "''", "''", "CAST(NULL AS VARCHAR)")])


@query("j4_routes", oracle=_d_routes)
def j4_routes(spark: SparkSession, sf: str) -> DataFrame:
    """HTML, grids, TSV, plain text and empty payloads go through their branches in one job that reads them once."""
    pages = documents(spark, sf, *SELECTED).filter(F.col("doc_id") % 5 == 1)
    return DV.route_entries(_mixed(spark, sf), aria_grids(pages))


# ---------------------------------------------------------------------------------------------------------------
# K13, C4, marks

@query("k13_keep", oracle=lambda: expected("before", "", "<table><thead></thead><tbody><tr><td>{name}</td><td><b>{key}</b></td></tr></tbody></table>", "", "| {key} |", "| --- |"))
def k13_keep(spark: SparkSession, sf: str) -> DataFrame:
    """A table whose head has no row is neither promoted nor has a heading row, so it stays markup."""
    return DV.to_markdown(documents(spark, sf, "<p>before</p><table><thead>\n</thead><tbody><tr><td>{name}</td><td><b>{key}</b></td></tr></tbody></table>", "<table><tr><td>{key}</td></tr></table>"))


@query("c4_pre", oracle=lambda: expected("x", "", "{name}", "  two  \\*{key}", "\ttab", "", "end of it"))
def c4_pre(spark: SparkSession, sf: str) -> DataFrame:
    """C4: white space inside ``pre`` stays, with or without ``code``; elsewhere runs of it collapse."""
    return markdown_of(documents(spark, sf, "<p>x</p><pre>\n{name}\n  two  *{key}\n\ttab\n</pre>", "<p>end\n  of it</p>"))


@query("k18_marks", oracle=lambda: expected("a \u0001x **{key}**   [](/)  ", "`{name}`"))
def k18_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Control and private-use characters of the input come out as they went in."""
    return markdown_of(documents(spark, sf, "<p>a \u0001x <b>{key}</b>   <a href='/'></a><br><code>{name}</code></p>"))


@query("k8_backticks", oracle=lambda: expected("`````a`b``c```d````{key}````` `{name}`"))
def k8_backticks(spark: SparkSession, sf: str) -> DataFrame:
    """K7/K8: the delimiter is the shortest run of backticks that the code doesn't hold, however many it holds."""
    return markdown_of(documents(spark, sf, "<p><code>a`b``c```d````{key}</code> <code>{name}</code></p>"))


@query("d2_nested", oracle=lambda: expected("{name} kept", "", "after {key}"))
def d2_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Elements dropped with their content go with elements of their own kind inside them."""
    return markdown_of(documents(spark, sf, "<p>{name}<object>a<object>b{key}</object>c</object> kept</p><svg><g><svg/><text>x</text></g></svg>", "<template><p>t</p><template>u</template>v</template><p>after {key}</p>"))


@query("c2_implied", oracle=lambda: expected("{name}", "", "next", "", "*   one", "*   two", "    *   in {key}", "*   three", "", "| 1 | 2 |", "| --- | --- |", "| {name} | {key} |", "", "end"))
def c2_implied(spark: SparkSession, sf: str) -> DataFrame:
    """End tags that the source left out are inferred - items, cells, rows and paragraphs end at the next of their kind."""
    return DV.to_markdown(documents(spark, sf, "<p>{name}<p>next<ul><li>one<li>two<ul><li>in {key}</ul><li>three</ul>", "<table><tr><td>1<td>2<tr><td>{name}<td>{key}</table><div>end</div>"))


@query("k15_direct", oracle=lambda: expected("*   [x] {name}", "*   [ ] ~{key}~", "", "```sql", 'SELECT  "{name}"', "  FROM t", "```", "", "```python", "x = {key}", "```"))
def k15_direct(spark: SparkSession, sf: str) -> DataFrame:
    """Task boxes, strikethrough, highlighted code and the language of code, where no sanitizer has run."""
    p = documents(spark, sf, '<ul><li><input type="checkbox" checked>{name}</li><li><input type="checkbox"><del>{key}</del></li></ul>',
                  '<div class="highlight highlight-source-sql"><pre><span>SELECT</span>  "{name}"\n  FROM t</pre></div><pre><code class="language-python">x = {key}\n</code></pre>')
    t = with_tree(with_spans(to_nodes(p, doc_marker=True)))
    return render_markdown(t, rules=RU.gfm_strikethrough(spark))


@query("f8_dedup", oracle=lambda: "SELECT min(CAST(s_suppkey AS BIGINT)) AS doc_id, count(*) AS copies FROM supplier GROUP BY s_nationkey")
def f8_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """F8: entries that are the same in canonical form are one, with the number of copies; spelling differs by supplier."""
    s = load_table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"])
    row = F.concat(F.lit("<tr><td>"), F.col("s_nationkey").cast("string"), F.lit("</td></tr>"))
    html = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<meta charset=utf-8><table><tbody>\n"), row, F.lit("</tbody></table><!-- x -->"))).otherwise(
        F.concat(F.lit(" <table>"), row, F.lit("</table>")))
    return dedup_entries(s.select(F.col("s_suppkey").cast("bigint").alias("doc_id"), html.alias("html"))).select("doc_id", "copies")


@query("x4_strategies", oracle=lambda: stated(strategy="CASE WHEN s_suppkey % 2 = 0 THEN 'native' ELSE 'aria' END", text=["{name}"]))
def x4_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """A list of strategies over one page; native tables win where there are any."""
    p = documents(spark, sf, '<div role="grid"><div role="row"><span role="cell">{name}</span></div></div><table><tr><td>{name}</td></tr></table>')
    p = p.withColumn("html", F.when(F.col("doc_id") % 2 == 1, F.regexp_replace("html", "<table.*", "")).otherwise(F.col("html")))
    return G.extract_grids(tree(p), [("native", G.native_cells), ("aria", G.aria_cells)]).select("doc_id", "strategy", "text")


# ---------------------------------------------------------------------------------------------------------------
# E8, E9, F5, F6

@query("e8_markup", oracle=lambda: " UNION ALL ".join(
    stated(table_no=f"CAST({t} AS INTEGER)", r=f"CAST({r} AS INTEGER)", c=f"CAST({c} AS INTEGER)", text=text, html=html) for t, r, c, text, html in (
        (0, 0, 0, ["{name} tail"], ['<i>{name}</i><table><tbody><tr><td><a href="u">{key}</a></td></tr></tbody></table> tail']), (0, 0, 1, ["b & c"], ["b &amp; c<br>"]), (1, 0, 0, ["{key}"], ['<a href="u">{key}</a>']))))
def e8_markup(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell with its markup, also that of a table inside it, whose cells are cells of their own."""
    p = documents(spark, sf, '<table><tr><td><i>{name}</i><table><tbody><tr><td><a href="u">{key}</a></td></tr></tbody></table> tail</td><td>b &amp; c<br></td></tr></table>')
    return G.native_cells(tree(p)).select("doc_id", "table_no", "r", "c", "text", "html")


NESTED = ('<div role="grid"><div role="row"><span role="gridcell">{name}</span><span role="gridcell">in <table><tr><td>hidden {key}</td></tr></table> out</span></div>',
          '<table><tr><td>chart</td></tr></table><div role="row"><span role="gridcell">{key}</span><span role="rowheader">z</span></div></div>')


@query("f6_nested_rows", oracle=lambda: " UNION ALL ".join(
    stated(r=f"CAST({r} AS INTEGER)", c=f"CAST({c} AS INTEGER)", text=text) for r, c, text in (
        (0, 0, ["{name}"]), (0, 1, ["in hidden {key} out"]), (1, 0, ["{key}"]), (1, 1, ["z"]))))
def f6_nested_rows(spark: SparkSession, sf: str) -> DataFrame:
    """rows of a native table inside an ARIA root are not rows of the grid."""
    return G.aria_cells(tree(documents(spark, sf, *NESTED))).select("doc_id", "r", "c", "text")


@query("e9_hybrid", oracle=lambda: " UNION ALL ".join(
    stated(r=f"CAST({r} AS INTEGER)", c=f"CAST({c} AS INTEGER)", is_header=h, text=text) for r, c, h, text in (
        (0, 0, "true", ["H"]), (0, 1, "false", ["{key}"]), (1, 0, "false", ["{name}"]), (1, 1, "true", ["col"]))))
def e9_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """A root that is a native table has its ``tr`` as rows and their ``td``/``th`` as cells, next to ARIA rows."""
    p = documents(spark, sf, '<table role="treegrid"><tr><th>H</th><td>{key}</td></tr>', '<tr role="row"><td role="cell">{name}</td><td>no role</td><td role="columnheader">col</td></tr></table>')
    return G.aria_cells(tree(p)).select("doc_id", "r", "c", "is_header", "text")


@query("f5_closest", oracle=lambda: " UNION ALL ".join(
    stated(text=text, in_table=t, in_root=r, in_cell=c) for text, t, r, c in (
        (["{name}"], "true", "true", "true"), (["{key}"], "true", "true", "true"), (["after"], "false", "true", "false"), (["out"], "false", "false", "false"))))
def f5_closest(spark: SparkSession, sf: str) -> DataFrame:
    """which table, ARIA root and cell hold each text, for all three at once; closed elements hold nothing."""
    p = documents(spark, sf, '<div role="grid"><table><tr><td>{name}<table><tr><td>{key}</td></tr></table></td></tr></table>after</div>out')
    n = with_closest(with_spans(to_nodes(p)), table=F.col("tag") == "table", root=role().isin(G.ARIA_ROOT_ROLES), cell=F.col("tag").isin("td", "th"))
    return n.filter(F.col("kind") == "text").select("doc_id", "text", *[F.col(c).isNotNull().alias(f"in_{c}") for c in ("table", "root", "cell")])

