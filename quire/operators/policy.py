"""Policy filters (D1-D7, F10): tag and attribute allowlists as a small dimension table.

The policy is a DataFrame of a few dozen rows ``(profile, tag, action)``. Joining it to ``nodes`` is a broadcast
hash join whose size is bounded by construction (the lists below), so no node row is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
#
# Tags kept by the sanitizer (anything else is unwrapped: its tags go, its children stay).
ALLOWED_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "li", "b", "i", "strong", "em", "u", "a", "img",
                "table", "thead", "tbody", "tr", "th", "td", "br", "hr", "blockquote", "code", "pre", "div",
                "section", "article", "figure", "figcaption", "header", "footer", "main", "aside"]
# Attributes kept by the sanitizer; data-* attributes are dropped, aria-* survive.
ALLOWED_ATTR = ["href", "src", "alt", "title", "width", "height"]
# Tags of the strict grid profile (no attributes at all).
GRID_ALLOWED_TAGS = ["table", "thead", "tbody", "tr", "th", "td"]
# Containers that say nothing on their own, and the one whose nesting is unwrapped.
PLAIN_CONTAINERS = ["div", "section", "article", "header", "footer", "main", "aside"]
UNWRAPPABLE = "div"
# Elements a renderer treats as a block (whitespace touching them is dead).
BLOCK_TAGS = ["div", "section", "article", "header", "footer", "main", "aside", "figure", "figcaption", "p", "h1",
              "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "pre", "hr", "table", "thead", "tbody",
              "tfoot", "tr", "th", "td"]
# ---------------------------------------------------------------------------------------------------------------

# The "styled" inspector profile additionally forbids these attributes and the <style> element.
STYLED_FORBID_ATTR = ["class", "id"]

PROFILES = {
    "default": (ALLOWED_TAGS, ALLOWED_ATTR),
    "grid": (GRID_ALLOWED_TAGS, []),
}


def policy_table(spark: SparkSession) -> DataFrame:
    """``policy(profile, tag, action, is_block, is_void, is_container)`` - tens of rows."""
    from .nodes import VOID_TAGS
    rows = []
    for profile, (tags, _) in PROFILES.items():
        for t in sorted(set(tags) | set(BLOCK_TAGS) | set(VOID_TAGS)):
            rows.append((profile, t, "keep" if t in tags else "unwrap", t in BLOCK_TAGS, t in VOID_TAGS,
                         t in PLAIN_CONTAINERS))
    return spark.createDataFrame(rows, "profile string, tag string, action string, is_block boolean, "
                                       "is_void boolean, is_container boolean")


def apply_tag_policy(nodes: DataFrame, profile: str = "default") -> DataFrame:
    """Keep text and allowed element tokens; a disallowed element is unwrapped (its tokens dropped).

    The allowlist is a literal ``IN`` set (Catalyst turns it into an ``InSet`` hash lookup), the cheapest form
    of a broadcast lookup; :func:`with_policy` is the join form for callers that need the flags as columns.
    """
    tags, _ = PROFILES[profile]
    return nodes.filter(F.col("kind").isin("text", "doc") | F.col("tag").isin(tags))


def with_policy(nodes: DataFrame, policy: DataFrame, profile: str = "default") -> DataFrame:
    """broadcast left join of the policy dimension on ``tag``."""
    p = policy.filter(F.col("profile") == profile).drop("profile")
    return nodes.join(F.broadcast(p), "tag", "left")


def apply_attr_policy(nodes: DataFrame, profile: str = "default") -> DataFrame:
    """D3: keep allowlisted attributes and ``aria-*``; ``data-*`` and the rest go. The document's marker keeps its facts."""
    _, attrs = PROFILES[profile]
    keep = F.map_filter("attrs", lambda k, v: k.isin(attrs) | k.startswith("aria-"))
    if profile == "grid":
        keep = F.map_filter("attrs", lambda k, v: F.lit(False))
    return nodes.withColumn("attrs", F.when(F.col("kind") == "doc", F.col("attrs")).when(F.col("attrs").isNotNull(), keep))


def apply_render_profile(nodes: DataFrame, keep_styles: bool) -> DataFrame:
    """The inspector's rendering profiles. Every tag stays (``<style>`` is already gone with its content);
    ``class``, ``id``, ``data-*`` and ``on*`` handlers go; ``style`` goes too unless ``keep_styles``, in which
    case only its allowed declarations survive and an attribute left empty is dropped."""
    from ..functions.style import rebuild_style_value
    forbid = ["class", "id"] + ([] if keep_styles else ["style"])
    keep = F.map_filter("attrs", lambda k, v: ~k.isin(forbid) & ~k.startswith("data-") & ~k.startswith("on"))
    n = nodes.withColumn("attrs", F.when(F.col("attrs").isNotNull(), keep))
    if keep_styles:
        fixed = F.transform_values("attrs", lambda k, v: F.when(k == "style", rebuild_style_value(v)).otherwise(v))
        n = n.withColumn("attrs", F.when(F.col("attrs").isNotNull(), F.map_filter(
            fixed, lambda k, v: (k != "style") | (v != ""))))
    return n


def sanitize(nodes: DataFrame, profile: str = "default") -> DataFrame:
    """D1 + D3 (D2, drop-with-content, happens in the tokenizer)."""
    return apply_attr_policy(apply_tag_policy(nodes, profile), profile)
