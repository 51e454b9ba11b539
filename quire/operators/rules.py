"""Conversion rule registry (X1, X2, K15): rules are rows, plugins are unions of rule sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = "tag string, action string, open_md string, close_md string, priority int"

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results (GFM strikethrough: one tilde).
STRIKETHROUGH_TAGS = ["del", "s", "strike"]
STRIKETHROUGH = "~"
# ---------------------------------------------------------------------------------------------------------------


def rule_set(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows`` of ``(tag, action, open_md, close_md, priority)``; action in replace / remove / keep."""
    return spark.createDataFrame(rows, RULE_SCHEMA)


def gfm_strikethrough(spark: SparkSession, priority: int = 1) -> DataFrame:
    """K15 plugin: ``del``/``s``/``strike`` as ``~text~`` (active in the direct profile, where the sanitizer
    has not removed those tags)."""
    return rule_set(spark, [(t, "replace", STRIKETHROUGH, STRIKETHROUGH, priority) for t in STRIKETHROUGH_TAGS])


def use(*rule_sets: DataFrame) -> DataFrame:
    """Combine a service's rules with plugins (later / higher priority rules win per tag)."""
    out = rule_sets[0]
    for r in rule_sets[1:]:
        out = out.unionByName(r)
    return out
