"""Blocks inside blocks: documents built from ``supplier`` whose oracles state the expected text itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import native_cells
from ..operators.nodes import to_nodes, with_spans, with_tree
from ..sources.tables import load_table
from .q_markdown import markdown_of
from .registry import query


def documents(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    """One document for each supplier: the parts joined, ``{name}`` and ``{key}`` filled in."""
    s = load_table(spark, sf, "supplier", ["s_suppkey", "s_name"])
    html = F.lit("".join(parts))
    for mark, col in (("{name}", "s_name"), ("{key}", "s_suppkey")):
        html = F.replace(html, F.lit(mark), F.col(col).cast("string"))
    return s.select(F.col("s_suppkey").cast("bigint").alias("doc_id"), html.alias("html"))


def expected(*lines: str) -> str:
    """SQL for the Markdown of each supplier's document, given line by line."""
    text = " || chr(10) || ".join("'" + x + "'" for x in lines)
    return f"SELECT CAST(s_suppkey AS BIGINT) AS doc_id, replace(replace({text}, '{{name}}', s_name), '{{key}}', CAST(s_suppkey AS VARCHAR)) AS markdown FROM supplier"


@query("k4_quotes", oracle=lambda: expected("> {name}", "> ", "> key {key}", "", "> other", "", "end"))
def k4_quotes(spark, sf):
    """K4: the paragraphs of a quote are one quote, two quotes are two."""
    return markdown_of(documents(spark, sf, "<blockquote><p>{name}</p><p>key {key}</p></blockquote>", "<blockquote><p>other</p></blockquote><p>end</p>"))


@query("k5_lists", oracle=lambda: expected("1.  {name}", "2.  {key}", "", "*   b", "*   c", "    *   d", "", "* * *", "", "end"))
def k5_lists(spark, sf):
    """K3/K5: neighbouring lists stay apart, nested items follow theirs, a rule between blocks."""
    return markdown_of(documents(spark, sf, "<ol><li>{name}</li><li>{key}</li></ol>", "<ul><li>b</li><li>c<ul><li>d</li></ul></li></ul><hr><p>end</p>"))


@query("k6_items", oracle=lambda: expected("*   {name}", "    ", "    key {key}", "    ", "*   plain"))
def k6_items(spark, sf):
    """K6: the marker stands before an item's first paragraph; the others are indented once."""
    return markdown_of(documents(spark, sf, "<ul><li><p>{name}</p><p>key {key}</p></li><li>plain</li></ul>"))


@query("k12_cell_blocks", oracle=lambda: expected("| H | K |", "| --- | --- |", "| {name}<br>*   one<br>*   two | {key} |"))
def k12_cell_blocks(spark, sf):
    """Blocks inside a cell are its lines."""
    return markdown_of(documents(spark, sf, "<table><tr><th>H</th><th>K</th></tr>", "<tr><td><p>{name}</p><ul><li>one</li><li>two</li></ul></td><td>{key}</td></tr></table>"))


@query("k8_inline_code", oracle=lambda: expected("``a`{key}`` `{name}`"))
def k8_inline_code(spark, sf):
    """K7/K8: a code span's delimiter is a run of backticks that its content does not hold."""
    return markdown_of(documents(spark, sf, "<p><code>a`{key}</code> <code>{name}</code></p>"))


@query("e8_nested", oracle=lambda: """
SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CAST(c[1] AS INTEGER) AS table_no, CAST(c[2] AS INTEGER) AS r, CAST(c[3] AS INTEGER) AS c, c[4] AS text
FROM (SELECT s_suppkey, unnest([['0', '0', '0', s_name || ' tail'], ['0', '0', '1', 'b'], ['0', '1', '0', 'c'],
                                ['1', '0', '0', CAST(s_suppkey AS VARCHAR)]]) AS c FROM supplier)""")
def e8_nested(spark, sf):
    """Cells of a table inside a cell are its own; what follows it is the outer cell's."""
    p = documents(spark, sf, "<table><tr><td>{name}<table><tr><td>{key}</td></tr></table> tail</td><td>b</td></tr>", "<tr><td>c</td></tr></table>")
    return native_cells(with_tree(with_spans(to_nodes(p)))).select("doc_id", "table_no", "r", "c", "text")


@query("c1_entities", oracle=lambda: expected("{name}’s été &lt; {key}"))
def c1_entities(spark, sf):
    """Numeric and named character references, each decoded once."""
    return markdown_of(documents(spark, sf, "<p>{name}&#8217;s &eacute;t&#xE9; &amp;lt; {key}</p>"))
