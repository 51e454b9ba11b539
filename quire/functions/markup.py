"""Repairs of markup before it is split into tokens: elements that go with their content, and end tags that a parser infers.

Both cut a text at the tags they are about and fold over the pieces, so they cost what these tags are and not what the text
is, and both leave texts alone that don't need them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------------
# Fixed values of HTML: whose end tags may be left out, and what ends them.
#
# Opener -> elements that it ends, if they are open inside the nearest of the scopes.
ENDS = {
    "li": (["li"], ["ul", "ol", "menu"]),
    "dd|dt": (["dd", "dt"], ["dl"]),
    "option": (["option"], ["select"]),
    "td|th": (["td", "th"], ["table"]),
    "tr": (["tr"], ["table"]),
    "thead|tbody|tfoot": (["thead", "tbody", "tfoot"], ["table"]),
    "p|address|article|aside|blockquote|div|dl|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|main|menu|nav|ol|pre|section|table|ul":
        (["p"], ["td", "th", "table", "caption", "button"]),
}
# Elements whose end tags may be left out.
OPTIONAL = ["li", "dd", "dt", "option", "td", "th", "tr", "thead", "tbody", "tfoot", "p"]
# Elements that bound them; a closing tag of these ends what is open inside.
BOUNDS = ["ul", "ol", "menu", "dl", "select", "table", "caption", "button", "div", "section", "article", "aside", "blockquote", "main", "form", "header", "footer", "nav", "figure", "fieldset"]
# ---------------------------------------------------------------------------------------------------------------


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_subtrees(html: Column, tags: list[str]) -> Column:
    """The elements of ``tags`` with everything inside them, elements of the same kind included, taken out. Where their
    tags don't balance, an opener takes what stands before the next end tag of its kind."""
    any_tag = "|".join(tags)
    closing, opening = f"(?is)^</(?:{any_tag})\\b[^>]*>", f"(?is)^<(?:{any_tag})\\b[^>]*>"
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(True).alias("sound"))

    def step(acc: Column, p: Column) -> Column:
        empty, opens, closes = p.rlike(f"(?is)^<(?:{any_tag})\\b[^>]*/>"), p.rlike(opening), p.rlike(closing)
        depth = acc["depth"] + F.when(empty, 0).when(opens, 1).when(closes, -1).otherwise(0)
        rest = F.regexp_replace(p, f"{opening}|{closing}", "")
        return F.struct(F.when(depth > 0, acc["out"]).otherwise(F.concat(acc["out"], rest)).alias("out"), F.greatest(depth, F.lit(0)).alias("depth"),
                        (acc["sound"] & (depth >= 0)).alias("sound"))

    simple = "(?is)" + "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in tags)

    def removed(h: Column) -> Column:
        folded = F.aggregate(F.split(h, f"(?i)(?=</?(?:{any_tag})\\b)"), start, step)
        return F.when(~h.rlike(f"<(?i:{any_tag})\\b"), h).otherwise(
            once(folded, lambda r: F.when((r["depth"] == 0) & r["sound"], r["out"]).otherwise(F.regexp_replace(h, simple, ""))))

    return once(html, removed)


def with_implied_ends(html: Column) -> Column:
    """End tags that the source left out, written where a parser infers them: an ``li`` ends at the next one of its list, a
    cell at the next cell or row of its table, a paragraph at the next block, all of them where the element around them ends.
    The open elements are a string with the innermost first (``td|tr|table|``); a text whose start and end tags are equally
    many, kind by kind, is left as it is."""
    tracked = "|".join(sorted({*OPTIONAL, *BOUNDS, *"|".join(ENDS).split("|")}, key=lambda t: (-len(t), t)))
    stacked = "|".join([*OPTIONAL, *BOUNDS])
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("ends"))

    def inner(stack: Column, ended: list[str], scopes: list[str]) -> Column:
        """The open elements up to the nearest of ``ended``, unless one of ``scopes`` stands before it."""
        return F.regexp_extract(stack, f"^((?:(?!(?:{'|'.join([*scopes, *ended])})\\|)[a-z0-9]+\\|)*+(?:{'|'.join(ended)})\\|)", 1)

    def step(acc: Column, p: Column) -> Column:
        stack = acc["open"]
        tag = F.lower(F.regexp_extract(p, f"(?i)^</?({tracked})\\b", 1))
        closes = F.substring(p, 1, 2) == "</"
        # an end tag ends what is open inside its element; one that has no element here does nothing
        found = F.call_function("instr", F.concat(F.lit("|"), stack), F.concat(F.lit("|"), tag, F.lit("|")))
        ended_by_close = F.when(closes & (tag != "") & (found > 0), F.substring(stack, F.lit(1), found - 1))
        ended_by_open = F.coalesce(*[F.when(~closes & tag.isin(openers.split("|")), inner(stack, ended, scopes)) for openers, (ended, scopes) in ENDS.items()], F.lit(""))
        ended = F.coalesce(ended_by_close, F.when(closes, F.lit("")).otherwise(ended_by_open))
        left = F.substring(stack, F.length(ended) + 1, F.length(stack))
        left = F.when(closes & (found > 0) & (tag != ""), F.substring(left, F.length(tag) + 2, F.length(left))).otherwise(left)
        pushed = F.when(~closes & tag.rlike(f"^(?:{stacked})$"), F.concat(tag, F.lit("|"), left)).otherwise(left)
        return F.struct(pushed.alias("open"), F.concat(acc["ends"], F.array(F.regexp_replace(ended, "([a-z0-9]+)\\|", "</$1>"))).alias("ends"))

    def closed(h: Column) -> Column:
        pieces = F.split(h, f"(?i)(?=</?(?:{tracked})\\b)")

        def written(ps: Column) -> Column:
            return once(F.aggregate(ps, start, step), lambda r: F.concat(
                F.array_join(F.zip_with(r["ends"], ps, lambda e, p: F.concat(e, p)), ""), F.regexp_replace(r["open"], "([a-z0-9]+)\\|", "</$1>")))

        uneven = None
        for t in ("li", "td", "th", "tr", "p", "d[dt]", "option", "t(?:head|body|foot)"):
            differs = F.regexp_count(h, F.lit(f"<(?i:{t})\\b")) != F.regexp_count(h, F.lit(f"</(?i:{t})\\b"))
            uneven = differs if uneven is None else uneven | differs
        return F.when(uneven, once(pieces, written)).otherwise(h)

    return once(html, closed)
