"""Tab-separated clipboard text as a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_trim

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
TSV_SOURCE_TYPE = "Plain Text (TSV Conversion)"
TSV_HEADER_CELL = '<th style="font-weight: normal;">'
LINE_SPLIT = "\r?\n"
# ---------------------------------------------------------------------------------------------------------------


def tsv_lines(plain: Column) -> Column:
    """Lines of the trimmed text (JS ``trim`` also eats leading tabs, NBSP and BOM)."""
    return F.split(js_trim(plain), LINE_SPLIT)


def first_line_tabs(plain: Column) -> Column:
    """Tab count of the first line."""
    return F.size(F.split(F.element_at(tsv_lines(plain), 1), "\t")) - 1


def is_tsv(html: Column, plain: Column) -> Column:
    """No html entry, non-empty text, at least two lines, a tab in the first line."""
    lines = tsv_lines(plain)
    has_html = F.coalesce(html.isNotNull() & (html != ""), F.lit(False))
    return (~has_html & plain.isNotNull() & (plain != "") & (F.size(lines) >= 2)
            & (F.size(F.split(F.element_at(lines, 1), "\t")) > 1))


def _fit(line: Column, n: Column) -> Column:
    """Split a row on tabs, pad with '' / truncate to ``n`` cells."""
    return F.slice(F.concat(F.split(line, "\t"), F.array_repeat(F.lit(""), n)), 1, n)


def _body(lines: Column) -> Column:
    return F.slice(lines, 2, F.size(lines) - 1)


def _per_row(n: Column, lines: Column) -> Column:
    """The header width once per body row, handed to the row lambda as an argument: a column referenced
    inside a lambda would be re-evaluated (re-split) for every row."""
    return F.array_repeat(n, F.greatest(F.size(lines) - 1, F.lit(0)))


def tsv_to_markdown(plain: Column) -> Column:
    """GFM table; every row padded or truncated to the header width; pipes are not escaped."""
    lines = tsv_lines(plain)
    header = F.split(F.element_at(lines, 1), "\t")
    n = F.size(header)
    head = F.concat(F.lit("| "), F.array_join(header, " | "), F.lit(" |\n"),
                    F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |\n"))
    rows = F.zip_with(_body(lines), _per_row(n, lines),
                      lambda r, k: F.concat(F.lit("| "), F.array_join(_fit(r, k), " | "), F.lit(" |\n")))
    return F.concat(head, F.array_join(rows, ""))


def html_escape_min(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def tsv_to_html(plain: Column) -> Column:
    """The built-in simple-HTML table builder (headers with ``font-weight: normal``)."""
    lines = tsv_lines(plain)
    header = F.split(F.element_at(lines, 1), "\t")
    n = F.size(header)
    ths = F.array_join(F.transform(header, lambda c: F.concat(F.lit(TSV_HEADER_CELL), html_escape_min(c),
                                                              F.lit("</th>\n"))), "")
    rows = F.zip_with(_body(lines), _per_row(n, lines), lambda r, k: F.concat(
        F.lit("<tr>\n"),
        F.array_join(F.transform(_fit(r, k), lambda c: F.concat(F.lit("<td>"), html_escape_min(c), F.lit("</td>\n"))),
                     ""),
        F.lit("</tr>\n")))
    return F.concat(F.lit("<table>\n<thead>\n<tr>\n"), ths, F.lit("</tr>\n</thead>\n<tbody>\n"),
                    F.array_join(rows, ""), F.lit("</tbody>\n</table>\n"))
