"""Comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import js_spaces_to_ascii, js_trim

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
SELECTION_PREFIX = 50     # characters of the selection whose words are checked
CLIP_PREFIX = 100         # characters of the clipboard text searched (non-table selections)
MAX_NEEDED = 3            # words that must match, at most
# ---------------------------------------------------------------------------------------------------------------


def words(c: Column) -> Column:
    """Words split on JavaScript whitespace, empties dropped."""
    return F.filter(F.split(js_spaces_to_ascii(c), "\\s+"), lambda w: F.length(w) > 0)


def stale_check(selected: Column, clip: Column, is_table: Column) -> Column:
    """``struct(checked, match_count, needed, is_stale)``. Repeated selection words count each time;
    with either text empty the check is skipped."""
    check = words(F.substring(selected, 1, SELECTION_PREFIX))
    search = F.when(is_table, clip).otherwise(F.substring(clip, 1, CLIP_PREFIX))
    needed = F.when(is_table, F.lit(1)).otherwise(F.least(F.lit(MAX_NEEDED), F.size(check)))
    # A word (no whitespace inside) is one of the clipboard's words iff " word " occurs in the clipboard text
    # with whitespace runs collapsed to one space and a space at both ends: one linear pass over the text and
    # a substring search per selection word, instead of materialising the clipboard's word list.
    padded = F.concat(F.lit(" "), F.regexp_replace(js_spaces_to_ascii(search), "\\s+", " "), F.lit(" "))
    # the padded text rides in the fold's start value, which is evaluated once per row (an outer reference
    # inside the lambda would be re-evaluated for every word)
    count = F.aggregate(check, F.struct(padded.alias("p"), F.lit(0).alias("n")),
                        lambda acc, w: F.struct(acc["p"].alias("p"), (acc["n"] + F.when(
                            F.instr(acc["p"], F.concat(F.lit(" "), w, F.lit(" "))) > 0, 1).otherwise(0)).alias("n")),
                        lambda acc: acc["n"])
    checked = F.coalesce((selected != "") & (clip != ""), F.lit(False))
    stale = checked & (count < needed) & (F.size(check) > 0)
    return F.struct(checked.alias("checked"), F.when(checked, count).alias("match_count"),
                    F.when(checked, needed).alias("needed"), stale.alias("is_stale"))


# ---------------------------------------------------------------------------------------------------------------
# D15 / F8 canonical HTML

# Fixed values that must equal the reference for equal results: tags that a comparison ignores.
CANONICAL_DROP_TAGS = ["meta", "base"]
CANONICAL_UNWRAP_TAGS = ["tbody"]
TABLE_STRUCTURE = ["table", "thead", "tbody", "tfoot", "tr"]
# End of fixed values.


def canonical_html(payloads, html_col: str = "html"):
    """``(doc_id, canonical)`` - comments (tokenizer), ``meta``/``base`` and ``tbody`` tags dropped,
    whitespace-only text directly inside table structure dropped, re-serialized and trimmed."""
    from pyspark.sql import functions as F
    from .nodes import to_nodes, with_spans, with_tree
    from .render_html import to_html
    from .repair import blank_text
    n = to_nodes(payloads, "doc_id", html_col, doc_marker=True)
    n = n.filter(~F.coalesce(F.col("tag").isin(CANONICAL_DROP_TAGS + CANONICAL_UNWRAP_TAGS), F.lit(False)))
    t = with_tree(with_spans(n))
    t = t.filter(~(blank_text() & F.coalesce(F.col("parent_tag").isin(TABLE_STRUCTURE), F.lit(False))))
    out = to_html(t, out_col="canonical")
    return out.withColumn("canonical", js_trim(F.col("canonical")))


def same_entry(pairs, left: str = "left_html", right: str = "right_html"):
    """F8: are two payloads the same entry? Both sides become rows of one relation (``doc_id * 2 + side``), so
    one canonicalisation pass and one aggregate decide every pair - no join of the two sides."""
    from pyspark.sql import functions as F
    both = pairs.select((F.col("doc_id") * 2).alias("doc_id"), F.col(left).alias("html")).unionByName(
        pairs.select((F.col("doc_id") * 2 + 1).alias("doc_id"), F.col(right).alias("html")))
    c = canonical_html(both)
    return (c.groupBy(F.floor(F.col("doc_id") / 2).alias("doc_id"))
             .agg((F.countDistinct(F.sha2("canonical", 256)) == 1).alias("same")))


def same_plain(left, right):
    """F8: are two plain entries the same once line ends and trailing white space are absorbed (K25)?"""
    from ..functions.text import normalize_text
    return normalize_text(F.coalesce(left, F.lit(""))) == normalize_text(F.coalesce(right, F.lit("")))


def dedup_entries(entries, html_col: str = "html"):
    """F8: of the entries that are the same in canonical form, the one with the smallest doc_id, with its columns and the
    number of ``copies``. Digests are counted by a partial aggregate, so a form that most entries share is one row a task."""
    c = canonical_html(entries, html_col).select("doc_id", F.sha2("canonical", 256).alias("_form"))
    first = c.groupBy("_form").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("_form")
    return entries.join(first, "doc_id")
