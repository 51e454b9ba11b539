"""Inline-style declaration policy (D6, D7, X3) as Column expressions - no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
#
# Value functions that make the browser fetch.
FETCHING_FUNCTION = ("(?i)(?:^|[^\\w-])(?:-webkit-image-set|image-set|-webkit-cross-fade|cross-fade|-webkit-canvas|"
                     "element|image|paint|url|src)\\(")
# Legacy scripting hooks.
LEGACY_SCRIPTING = "(?i)(?:expression|-moz-binding|behavior)\\s*[(:]"
# Positions that leave the flow.
OUT_OF_FLOW = "(?i)^(?:fixed|sticky|-webkit-sticky)$"
# A property name.
PROPERTY_NAME = "^-?[a-z][a-z0-9-]*$"
# ---------------------------------------------------------------------------------------------------------------


def style_verdict(prop: Column, value: Column) -> Column:
    """X3 ``isAllowed`` with the reason: NULL when allowed, else the refusing rule."""
    name = F.lower(prop)
    return (F.when(F.coalesce(prop, F.lit("")) == "", F.lit("empty"))
             .when(F.coalesce(value, F.lit("")) == "", F.lit("empty"))
             .when(name.startswith("--"), F.lit("custom-property"))
             .when(~name.rlike(PROPERTY_NAME), F.lit("malformed-name"))
             .when(value.rlike(FETCHING_FUNCTION), F.lit("fetching-function"))
             .when(value.rlike(LEGACY_SCRIPTING), F.lit("legacy-scripting"))
             .when((name == "position") & F.trim(value).rlike(OUT_OF_FLOW), F.lit("out-of-flow")))


def style_allowed(prop: Column, value: Column) -> Column:
    return style_verdict(prop, value).isNull()


def declarations(df: DataFrame, style_col: str = "style") -> DataFrame:
    """D6 part 1: one row per declaration ``(…, decl_no, prop, value, important)``; empty pieces skipped."""
    d = df.select("*", F.posexplode(F.split(F.col(style_col), ";")).alias("decl_no", "_decl"))
    d = d.filter(F.trim("_decl") != "")
    prop = F.lower(F.trim(F.regexp_extract("_decl", "^([^:]*)", 1)))
    raw = F.trim(F.regexp_extract("_decl", "(?s)^[^:]*:(.*)$", 1))
    important = raw.rlike("(?i)!\\s*important$")
    value = F.trim(F.regexp_replace(raw, "(?i)\\s*!\\s*important$", ""))
    return d.withColumn("prop", prop).withColumn("value", value).withColumn("important", important).drop("_decl")


def style_audit(df: DataFrame, style_col: str = "style") -> DataFrame:
    """Every declaration with ``allowed`` and ``reason``."""
    d = declarations(df, style_col)
    return d.withColumn("reason", style_verdict(F.col("prop"), F.col("value"))) \
            .withColumn("allowed", F.col("reason").isNull())


def rebuild_style(audit: DataFrame, key: str = "doc_id") -> DataFrame:
    """The style attribute rebuilt from allowed declarations in order, ``!important`` kept."""
    kept = F.when(F.col("allowed"), F.struct(F.col("decl_no").alias("n"), F.concat(
        F.col("prop"), F.lit(": "), F.col("value"),
        F.when(F.col("important"), F.lit(" !important")).otherwise(F.lit(""))).alias("v")))
    return (audit.groupBy(key)
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["v"]), "; ")
                      .alias("style")))


def rebuild_style_value(style: Column) -> Column:
    """D5/D7 on one attribute value, without exploding rows: the declarations that pass the policy, in order,
    ``!important`` kept, joined by ``'; '`` ('' when none survives)."""
    decls = F.filter(F.split(F.coalesce(style, F.lit("")), ";"), lambda d: F.trim(d) != "")

    def parse(d):
        raw = F.trim(F.regexp_extract(d, "(?s)^[^:]*:(.*)$", 1))
        return F.struct(F.lower(F.trim(F.regexp_extract(d, "^([^:]*)", 1))).alias("prop"),
                        F.trim(F.regexp_replace(raw, "(?i)\\s*!\\s*important$", "")).alias("value"),
                        raw.rlike("(?i)!\\s*important$").alias("important"))
    parsed = F.transform(decls, parse)
    kept = F.filter(parsed, lambda x: style_verdict(x["prop"], x["value"]).isNull())
    return F.array_join(F.transform(kept, lambda x: F.concat(
        x["prop"], F.lit(": "), x["value"], F.when(x["important"], F.lit(" !important")).otherwise(F.lit("")))), "; ")
