"""Pages -> Markdown (the flagship) and the shared HTML pipeline pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.nodes import to_nodes, with_spans, with_tree
from ..operators.policy import ALLOWED_TAGS, sanitize
from ..operators.render_md import render_markdown
from ..sources.tables import load_table
from . import duck as D
from .registry import query


def pages_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` as payloads ``(doc_id, url, html)``."""
    return load_table(spark, sf_dir, "pages", ["page_id", "url", "html"]).withColumnRenamed("page_id", "doc_id")


def markdown_of(payloads: DataFrame) -> DataFrame:
    """Payload HTML -> sanitized node tree -> Markdown (documents with nothing to render give '')."""
    tree = with_tree(with_spans(sanitize(to_nodes(payloads, doc_marker=True))), items=True)
    return render_markdown(tree)


def pages_src() -> str:
    return "(SELECT page_id AS doc_id, url, html FROM pages)"


def markdown_sql(src: str, select: str, extra_ctes: str = "") -> str:
    """WITH src AS <src>, nodes..., markdown...  <select with {out}>"""
    nodes, tree = D.nodes_ctes("src", "n", ALLOWED_TAGS)
    md, out = D.render_md_ctes(tree, "src", "m")
    return f"WITH src AS {src},{nodes},{md}{extra_ctes}\n{select.format(out=out)}"


@query("k_pages_to_markdown_blocks",
       oracle=lambda: markdown_sql(pages_src(), "SELECT doc_id AS page_id, markdown FROM {out}"))
def k_pages_to_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every page rendered to Markdown blocks."""
    return markdown_of(pages_payloads(spark, sf_dir)).withColumnRenamed("doc_id", "page_id")
