"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

Every line with a word is known by the digest of its text without surrounding white space. Sites of a line are
counted by HyperLogLog sketches, which merge as partial aggregates before and after the shuffle; a line on a third of
all documents costs one small sketch for each task. Where the estimate lies within ``BAND`` of the threshold, the
distinct sites are counted exactly; all others are decided by the estimate. A line on ``min_sites`` sites or more is
removed from every document but its first (smallest doc_id, then smallest place), so that no passage is lost.

The lines of all texts are written once to a table in the shared folder and the removals join back by document.

Nulls and corner cases: a null site is a site of its own; a null text stays null and has no lines; lines without a
word are never boilerplate and stay; of rows that repeat a doc_id, equal ones are one document and different ones are
ordered by their texts' hashes; a null doc_id comes before all others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved

MIN_SITES = 10
#: Share of the threshold on either side of it within which sites are counted exactly; about six standard errors of
#: a sketch of 2^12 registers.
BAND = 0.1
SPACE = " \t\n\r\x0b\x0c"


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def line_table(docs: DataFrame, site: str) -> DataFrame:
    """``doc_id, row, pos, site, key`` of every line with a word."""
    where = F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("null"))
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), where.alias("site"), F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).where("line <> ''")
    return lines.select("doc_id", "row", "pos", "site", F.unhex(F.md5("line")).alias("key"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """``key, first``: the lines on ``min_sites`` sites or more, and where each stands first."""
    place = F.struct("doc_id", "row", "pos")
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site").alias("sites"), F.min(place).alias("first"))
    spread = spread.select("key", "first", F.hll_sketch_estimate("sites").alias("sites")).where(F.col("sites") >= min_sites * (1 - band) - 1)
    spread = saved(spread, "spread")
    sure = F.col("sites") > min_sites * (1 + band) + 1
    exact = lines.join(spread.where(~sure).select("key"), "key", "left_semi").groupBy("key").agg(F.count_distinct("site").alias("n"))
    near = spread.where(~sure).join(exact.where(F.col("n") >= min_sites), "key", "left_semi")
    return spread.where(sure).unionAll(near).select("key", "first")


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_removed``."""
    lines = saved(line_table(docs, site), "lines")
    found = saved(boilerplate(lines, min_sites, band), "boilerplate")
    place = F.struct("doc_id", "row", "pos")
    removed = lines.join(found, "key").where(~place.eqNullSafe(F.col("first")))
    removed = removed.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("pos").alias("_removed"))
    removed = saved(removed, "removed")
    x = docs.withColumn("_own", F.xxhash64("text"))
    x = x.join(removed, x["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_row")), "left")
    kept = let(F.struct(_split(F.col("text")).alias("lines"), F.col("_removed").alias("removed")), lambda t: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(t["lines"]) - 1), t["removed"]), lambda i: F.get(t["lines"], i)), "\n"))
    text = F.when(F.col("_removed").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_split(F.col("text")))).cast("long")
    n_removed = F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).cast("long")
    own = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return x.select(*own, text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


ORACLE_LINES = rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM l),
spread AS (
  SELECT k, count(DISTINCT coalesce('=' || source, 'null')) AS sites, min((doc_id, pos)) AS f
  FROM t WHERE k <> '' GROUP BY k HAVING sites >= {MIN_SITES}),
marked AS (SELECT t.*, s.k IS NOT NULL AND (t.doc_id, t.pos) <> s.f AS gone FROM t LEFT JOIN spread s USING (k)),
cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN c.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""
