"""Document <-> relation: HTML held as one row per token.

Token dialect (our stated deviation from HTML5 tree building):

* comments, doctype / processing instructions and the drop-with-content elements are removed first; with ``implied``, as in
  the entries job, end tags that the source left out are written where a parser infers them;
* a tag is ``</?name ...>`` where quoted attribute values may hold ``>``; a lone ``<`` is text;
* tag and attribute names are lower-cased, the first duplicate attribute wins;
* void tags never open a level; closers are matched to openers per tag (stack order), unmatched closers are
  dropped, unmatched openers get no extent (their content belongs to the parent);
* character references (decimal, hexadecimal, the named ones of HTML 4) are decoded once.

All windows are partitioned by ``doc_id`` (alone or with more keys), so after one ``doc_id`` exchange every
window and per-document aggregate below runs without another shuffle; a window frame holds one document at most.
The exchange has as many partitions as the markup asks for (:func:`tasks_for`): a row of it is a text that compresses well
and becomes many wide rows, so its bytes, from which AQE would coalesce, say nothing about the memory of a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import with_implied_ends, without_subtrees
from ..functions.text import decode_entities

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
#
# Void elements (never hold content).
VOID_TAGS = ["area", "base", "br", "col", "command", "embed", "hr", "img", "input", "keygen", "link", "meta",
             "param", "source", "track", "wbr"]
# Block elements of the Markdown renderer.
RENDER_BLOCK_TAGS = ["address", "article", "aside", "audio", "blockquote", "body", "canvas", "center", "dd", "dir",
                     "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1",
                     "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "isindex", "li", "main",
                     "menu", "nav", "noframes", "noscript", "ol", "output", "p", "pre", "section", "table",
                     "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
# ---------------------------------------------------------------------------------------------------------------

# Elements removed together with everything inside them (dialect decision; the sanitizer drops svg, script and
# style whole, and a corpus job has no use for the rest either).
DROP_WITH_CONTENT = ["script", "style", "title", "head", "noscript", "iframe", "textarea"]
# ... and those that may hold elements of their own kind.
DROP_SUBTREES = ["template", "svg", "math", "object", "audio", "video"]

# Markup removed before tokenising: comments, doctype / CDATA / processing instructions, drop-with-content
# elements (unrolled alternation: no back-references, so the same pattern runs on RE2).
STRIP_RE = "(?is)<!--.*?-->|<![^>]*>|<\\?[^>]*>|" + "|".join(
    f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in DROP_WITH_CONTENT)
# The same with what all of them begin with in front, so that other characters are passed over at once.
STRIP_AT_TAG_RE = "(?is)<(?:!--.*?-->|![^>]*>|\\?[^>]*>|" + "|".join(
    f"{t}\\b[^>]*>.*?</{t}\\s*>" for t in DROP_WITH_CONTENT) + ")"

# A tag, else a run of text, else a lone '<'. Possessive quantifiers keep Java's matcher iterative on long tags.
TOKEN_RE = "</?[A-Za-z][^\\s/>]*(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<"
TAG_NAME_RE = "^</?([A-Za-z][^\\s/>]*)"
ATTR_RE = "[^\\s\"'>/=]+(?:\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s\"'>]+))?"
ATTR_KV_RE = "([^\\s\"'>/=]+)(?:\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+)))?"
# a tag carries attributes only if something follows its name
HAS_ATTRS_RE = "^<[A-Za-z][^\\s/>]*[\\s/]+[^\\s/>]"


def w_doc():
    """Document order window; every node window shares ``partitionBy(doc_id)``."""
    return Window.partitionBy("doc_id").orderBy("pos")


def running():
    """Running frame over document order (prefix sums, carries)."""
    return w_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def following(name: str, order: str = "pos") -> Column:
    """The nearest value behind the token that is not null, of a column given by its name. Ignoring nulls, ``lead`` passes over
    a document once; a frame of all that follows would be read anew for each token."""
    return F.expr(f"lead(`{name}`) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY {order})")


def clean_markup(html: Column, implied: bool = False) -> Column:
    """Without what is dropped whole (D2); if asked, with the end tags that a parser infers."""
    kept = without_subtrees(F.regexp_replace(html, STRIP_AT_TAG_RE, ""), DROP_SUBTREES)
    return with_implied_ends(kept) if implied else kept


#: What a task is dealt: tokens, where 256 bytes of text count as one too. A sort of that many token rows takes one page of 64 MB.
TASK_TOKENS = 65_536
TOKEN_BYTES = 256
#: Partitions of one exchange at most; tasks of larger inputs get more, and their sorts spill.
MAX_TASKS = 50_000


def markup_size(html: Column) -> Column:
    """Tokens of a text: the tags, the texts that stand behind a tag, and one for ``TOKEN_BYTES``."""
    tags = F.octet_length(html) - F.octet_length(F.replace(html, F.lit("<"), F.lit("")))
    return F.coalesce(tags + F.regexp_count(html, F.lit(">[^<]")) + F.octet_length(html) / TOKEN_BYTES, F.lit(0)) + 1


def total_size(df: DataFrame, size: Column) -> float:
    """A number summed over all rows, by a job of its own that reads only what the number needs."""
    return df.agg(F.sum(size).alias("n")).first()["n"] or 0


def tasks_for(size: float) -> int:
    """Two at least, for a single partition isn't hashed by ``doc_id``."""
    return min(max(math.ceil(size / TASK_TOKENS), 2), MAX_TASKS)


def tokenize(df: DataFrame, id_col: str = "doc_id", html_col: str = "html", partitions: int | None = None,
             prepartitioned: bool = False, doc_marker: bool = False, facts_col: str | None = None,
             implied: bool = False) -> DataFrame:
    """C1 part 1: ``(doc_id, pos, tok)``.

    The payload rows are hash-partitioned by ``doc_id`` *before* exploding, so the exchange moves one row per
    document instead of one per token, and every later window / per-doc aggregate reuses that partitioning. Without
    ``partitions`` a job counts the markup for their number.
    Pass ``prepartitioned=True`` for a source already bucketed by ``doc_id`` (then there is no exchange at all).
    """
    facts = [F.col(facts_col).alias("facts")] if facts_col else []
    d = df.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html"), *facts)
    if not prepartitioned:
        d = d.repartition(partitions or tasks_for(total_size(d, markup_size(F.col("html")))), "doc_id")
    toks = F.regexp_extract_all(clean_markup(F.col("html"), implied), F.lit(TOKEN_RE), 0)
    if not doc_marker:
        return d.select("doc_id", F.posexplode(toks).alias("pos", "tok"))
    # an empty token at position -1 marks the document itself, so a per-document result exists even when the
    # document has nothing to render - no join back to the payloads is needed
    toks = F.concat(F.array(F.lit("")), F.coalesce(toks, F.array().cast("array<string>")))
    n = d.select("doc_id", *(["facts"] if facts else []), F.posexplode(toks).alias("pos", "tok")).withColumn("pos", F.col("pos") - 1)
    return n.withColumn("facts", F.when(F.col("pos") == -1, F.col("facts"))) if facts else n


def _attrs(tok: Column) -> Column:
    """Attribute map of a tag token; names lower-cased, values unquoted and decoded, first duplicate wins.

    Three group extractions (double-quoted, single-quoted, bare value) avoid a per-attribute regex call."""
    raw = F.regexp_replace(tok, "^<[A-Za-z][^\\s/>]*|/?>$", "")
    names = F.transform(F.regexp_extract_all(raw, F.lit(ATTR_KV_RE), 1), lambda k: F.lower(k))
    dq = F.regexp_extract_all(raw, F.lit(ATTR_KV_RE), 2)
    sq = F.regexp_extract_all(raw, F.lit(ATTR_KV_RE), 3)
    bare = F.regexp_extract_all(raw, F.lit(ATTR_KV_RE), 4)
    values = F.zip_with(F.zip_with(dq, sq, lambda a, b: F.concat(a, b)), bare, lambda a, b: F.concat(a, b))
    pairs = F.arrays_zip(names.alias("k"), F.transform(values, decode_entities).alias("v"))
    # first duplicate wins; a fold over the pairs (lambdas see only their own arguments, so nothing outside
    # is re-evaluated per attribute)
    empty = F.array().cast("array<struct<k:string,v:string>>")
    first = F.aggregate(pairs, empty, lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc)
                        .otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(first)


def classify(tokens: DataFrame) -> DataFrame:
    """C1 part 2: ``kind`` (open/close/void/text), ``tag``, ``attrs`` map, decoded ``text``."""
    tok = F.col("tok")
    is_tag = (F.substring(tok, 1, 1) == "<") & (F.length(tok) > 1)
    tag = F.lower(F.regexp_extract(tok, TAG_NAME_RE, 1))
    kind = (F.when(tok == "", F.lit("doc"))
            .when(~is_tag, F.lit("text"))
            .when(F.substring(tok, 1, 2) == "</", F.lit("close"))
            .when(tag.isin(VOID_TAGS), F.lit("void"))
            .otherwise(F.lit("open")))
    return tokens.select(
        "*", kind.alias("kind"), F.when(is_tag, tag).alias("tag"),
        F.when(kind.isin("open", "void"), F.when(tok.rlike(HAS_ATTRS_RE), _attrs(tok))
               .otherwise(F.create_map().cast("map<string,string>"))).alias("attrs"),
        F.when(~is_tag & (tok != ""), decode_entities(tok)).alias("text"))


def to_nodes(df: DataFrame, id_col: str = "doc_id", html_col: str = "html", **kw) -> DataFrame:
    """Payloads -> ``nodes(doc_id, pos, kind, tag, attrs, text)``. ``facts_col`` names a map that becomes the attributes
    of the document's marker."""
    n = classify(tokenize(df, id_col, html_col, **kw)).drop("tok")
    return n.withColumn("attrs", F.coalesce("facts", "attrs")).drop("facts") if kw.get("facts_col") else n


def with_spans(nodes: DataFrame) -> DataFrame:
    """Match each opener to its closer per tag in stack order.

    Adds ``end_pos`` (position of the matching closer; NULL when unmatched) and ``matched`` (for open and close
    tokens). Level per (doc, tag) is a running sum of +1/-1; an opener at level L is closed by the next token of
    the same (doc, tag, L) partition when that is a closer.
    """
    el = F.col("kind").isin("open", "close")
    delta = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    w_tag = Window.partitionBy("doc_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = nodes.withColumn("_lvl", F.when(el, F.sum(delta).over(w_tag)))
    n = n.withColumn("_L", F.when(F.col("kind") == "close", F.col("_lvl") + 1).otherwise(F.col("_lvl")))
    w_lvl = Window.partitionBy("doc_id", "tag", "_L").orderBy("pos")
    nxt = F.lead(F.struct("kind", "pos")).over(w_lvl)
    prv = F.lag(F.struct("kind", "pos", "attrs")).over(w_lvl)
    n = n.withColumns({"_nxt": F.when(el, nxt), "_prv": F.when(el, prv)})
    kind = F.col("kind")
    end_pos = F.when((kind == "open") & (F.col("_nxt.kind") == "close"), F.col("_nxt.pos")) \
               .when(kind == "void", F.col("pos"))
    matched = F.when(kind == "open", end_pos.isNotNull()) \
               .when(kind == "close", F.coalesce(F.col("_prv.kind") == "open", F.lit(False))).otherwise(F.lit(True))
    # a matched closer knows its opener (position and attributes), e.g. a link's href at ``</a>``
    is_mc = (kind == "close") & matched
    cols = [c for c in n.columns if c not in ("_lvl", "_L", "_nxt", "_prv")]
    return n.select(*cols, end_pos.alias("end_pos"), matched.alias("matched"),
                    F.when(is_mc, F.col("_prv.pos")).alias("open_pos"),
                    F.when(is_mc, F.col("_prv.attrs")).alias("opener_attrs"))


def with_tree(nodes: DataFrame, items: bool = False) -> DataFrame:
    """``depth`` (matched elements strictly enclosing the token) and ``parent_pos`` (nearest enclosing
    matched opener, NULL at top level). Requires :func:`with_spans`.

    The parent lookup is an as-of match inside one document: a matched opener at depth d is the parent of the
    following tokens at depth d+1 until it closes. Each opener is emitted twice (as candidate and as child) and
    one ``last_value(ignore nulls)`` window per (doc, depth) does the match. There the children of a parent stand one after the
    other behind it, so two more things about them need no sort: with ``items`` the number of an ``li`` among those of its parent
    (``_li_idx``), with ``sibling`` the ``k`` (kind) and ``t`` (tag) of the nearest one before it that satisfies it (``_prev``).
    """
    mo = (F.col("kind") == "open") & F.col("matched")
    mc = (F.col("kind") == "close") & F.col("matched")
    step = F.when(mo, 1).when(mc, -1).otherwise(0)
    n = nodes.withColumn("_run", F.sum(step).over(running()))
    # depth = matched elements strictly enclosing the token; a matched opener counts itself in the running
    # sum, a matched closer has already left its element, so both end up at their element's own depth
    n = n.withColumn("depth", (F.col("_run") - F.when(mo, 1).otherwise(0)).cast("int")).drop("_run")
    roles = F.when(mo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = n.select("*", F.explode(roles).alias("_role"))
    x = x.withColumn("_key", F.when(F.col("_role") == 1, F.col("depth") + 1).otherwise(F.col("depth")))
    w = (Window.partitionBy("doc_id", "_key").orderBy("pos", F.col("_role").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    as_parent = F.col("_role") == 1
    li = (F.col("kind") == "open") & (F.col("tag") == "li") & ~as_parent
    cand = F.when(as_parent, F.struct("pos", "tag"))
    cols = [c for c in x.columns if c not in ("_role", "_key")]
    found = {"_par": F.last(cand, ignorenulls=True).over(w)}
    if items:
        found["_lis"] = F.sum(F.when(li, 1).otherwise(0)).over(w)
    x = x.withColumns(found)
    if items:
        before = F.last(F.when(as_parent, F.col("_lis")), ignorenulls=True).over(w)
        x = x.withColumn("_li_idx", F.when(li, F.col("_lis") - F.coalesce(before, F.lit(0))))
    return (x.filter(F.col("_role") == 0)
             .select(*cols, F.col("_par.pos").alias("parent_pos"), F.col("_par.tag").alias("parent_tag"), *(["_li_idx"] if items else [])))


def nesting(is_el: Column) -> Column:
    """How many matched elements of ``is_el`` hold the token (an opener counts as inside itself, a closer as outside)."""
    mo = (F.col("kind") == "open") & F.col("matched")
    mc = (F.col("kind") == "close") & F.col("matched")
    return F.sum(F.when(is_el & mo, 1).when(is_el & mc, -1).otherwise(0)).over(running())


def nesting_name(name: str) -> str:
    """The column in which :func:`enclosing` looks for the nesting depth of ``name``."""
    return f"_nest_{name}"


def enclosing(nodes: DataFrame, is_el: Column, name: str) -> DataFrame:
    """Adds ``name``: position of the nearest matched element of ``is_el`` that holds the token (an opener counts as
    inside itself, a closer as outside). The holder is the last one opened at the same nesting depth. That depth may have been
    added before (``nesting_name``), while the tokens were in document order."""
    mo = (F.col("kind") == "open") & F.col("matched")
    depth = nesting_name(name)
    n = nodes if depth in nodes.columns else nodes.withColumn(depth, nesting(is_el))
    w = Window.partitionBy("doc_id", depth).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.withColumn(name, F.last(F.when(is_el & mo, F.col("pos")), ignorenulls=True).over(w)).drop(depth)


def role() -> Column:
    """The ARIA role of an element, read at its opener or at its closer."""
    return F.coalesce(F.col("attrs")["role"], F.col("opener_attrs")["role"], F.lit(""))


def with_closest(nodes: DataFrame, **predicates: Column) -> DataFrame:
    """for each name the position of the nearest matched element that satisfies its predicate and holds the token (an
    opener counts as inside itself, a closer as outside). Predicates are asked at openers and closers. How deep a token is
    nested comes for all of them from one pass over document order; a holder is the last one opened at the token's depth."""
    mo, mc = (F.col("kind") == "open") & F.col("matched"), (F.col("kind") == "close") & F.col("matched")
    n = nodes.withColumns({f"_nest_{k}": F.sum(F.when(p & mo, 1).when(p & mc, -1).otherwise(0)).over(running()) for k, p in predicates.items()})
    for k, p in predicates.items():
        w = Window.partitionBy("doc_id", f"_nest_{k}").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n = n.withColumn(k, F.when(F.col(f"_nest_{k}") > 0, F.last(F.when(p & mo, F.col("pos")), ignorenulls=True).over(w)))
    return n.drop(*[f"_nest_{k}" for k in predicates])


def docs_with(nodes: DataFrame, predicate: Column) -> DataFrame:
    """the documents in which some token satisfies the predicate, once each; for ``left_semi`` and ``left_anti`` joins."""
    return nodes.filter(predicate).select("doc_id").distinct()


def members(nodes: DataFrame, is_el: Column, name: str = "el_pos") -> DataFrame:
    """A row for each token and each matched element of ``is_el`` that holds it, whose position is ``name``. An opener is
    also a member of itself, a closer only of the elements around its own. A token that stands in n elements becomes n rows,
    one for each level; at a level the holder is the last one opened there. No pairs and no interval join."""
    mo, mc = (F.col("kind") == "open") & F.col("matched"), (F.col("kind") == "close") & F.col("matched")
    n = nodes.withColumn("_nest", F.sum(F.when(is_el & mo, 1).when(is_el & mc, -1).otherwise(0)).over(running()))
    n = n.withColumn("_own", F.when(is_el & mo, F.col("_nest"))).filter(F.col("_nest") > 0)
    n = n.withColumn("_level", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_nest").cast("long"))))
    w = Window.partitionBy("doc_id", "_level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holder = F.last(F.when(F.col("_own") == F.col("_level"), F.col("pos")), ignorenulls=True).over(w)
    return n.withColumn(name, holder).drop("_nest", "_own", "_level")


def contents(nodes: DataFrame, is_el: Column, carry: dict[str, Column], html: bool = False) -> DataFrame:
    """One row for each matched element of ``is_el``: ``el_pos``, ``text`` (its ``textContent``), ``carry`` evaluated at
    its opener and, if asked, ``html`` (its ``innerHTML``). One aggregate over ``members``."""
    from .render_html import token_html
    kind = F.col("kind")
    # a closer is asked for its opener's attributes
    n = nodes.withColumns({f"_c_{k}": c for k, c in carry.items()} | {"_own_attrs": F.col("attrs")})
    n = n.withColumn("attrs", F.coalesce("attrs", "opener_attrs")).withColumn("_el", F.coalesce(is_el, F.lit(False)))
    n = members(n.withColumn("attrs", F.col("_own_attrs")).drop("_own_attrs"), F.col("_el"))
    own = (F.col("pos") == F.col("el_pos"))
    if not html:
        n = n.filter(own | (kind == "text"))
    piece = token_html(kind, F.col("tag"), F.col("attrs"), F.col("text"), F.col("matched"))
    if "before" in nodes.columns:
        piece = F.concat(F.coalesce(F.col("before"), F.lit("")), piece)
    out = n.groupBy("doc_id", "el_pos").agg(
        ordered_concat(F.col("pos"), F.when(kind == "text", F.col("text"))).alias("text"),
        *([ordered_concat(F.col("pos"), F.when(~own, piece)).alias("html")] if html else []),
        F.max(F.when(own, F.struct(F.lit(1), *[F.col(f"_c_{k}").alias(k) for k in carry]))).alias("o"))
    return out.select("doc_id", "el_pos", "text", *(["html"] if html else []), *[F.col("o")[k].alias(k) for k in carry])


def subtree_text(nodes: DataFrame, is_el: Column) -> DataFrame:
    """C7 ``textContent`` of every matched element of ``is_el``: ``(doc_id, pos, tag, text)``."""
    return contents(nodes, is_el, {"tag": F.col("tag")}).withColumnRenamed("el_pos", "pos")


def ordered_concat(pos: Column, piece: Column, sep: str = "") -> Column:
    """Aggregate: pieces concatenated in ``pos`` order; a group holds the pieces of one document at most."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), piece.alias("v")))),
                                    lambda s: s["v"]), sep)
