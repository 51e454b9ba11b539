"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Weights of sources are turned into words to take. A source stops at ``max_epochs`` times its size; the excess is
reshared by weight among the others until none is above. Sorting the sources by capacity over weight gives the
fixed point of that resharing in closed form: the clamped sources are a prefix of that order.

Each document is taken ``floor(target / size of its source)`` whole times. What is then missing of the target is
taken in an order seeded by the document's id: whole documents as long as they fit, and of the one that no longer
fits its first words (the fractional repetition). A source so takes its rounded target to the word.

The running sum needs no window over a source: documents are windowed within (source, leading digits of the seeded
order), and the sums of those buckets are summed in a second step. The digits follow the number of documents, and
the result does not depend on them.

Nulls and corner cases: a null source is a source of its own, after all others; a null or empty text has size 0 and
is taken 0 times; rows repeated in full are mixed as rows of their own; an empty table gives an empty plan. Only
``doc_id``, ``source`` and ``text`` are read; other columns never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
#: Documents that a window over one bucket of the seeded order holds on average in the largest case.
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source, to ``(source, source_size, weight, target)``.

    Sources by code point, null last, have the weights in turn. The windows are over sources, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(every),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # clamped: even if all sources before are clamped, its share of the rest reaches its cap
    s = s.withColumn("clamped", (F.col("total") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left"))
    s = s.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), F.lit(0)),
        "weights": F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(every),
    })
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.col("weights"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def seeded_order(doc_id: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _planned(docs: DataFrame, weights: tuple, max_epochs: int, seed: int) -> DataFrame:
    """Adds ``source_size, target, taken`` to ``docs``, which has ``doc_id, source, size`` and may have ``text``."""
    digits = max(1, math.ceil(math.log(max(1, docs.count()) / BUCKET_ROWS, 16)) + 1)
    docs = docs.withColumn("_order", seeded_order(F.col("doc_id"), seed)).withColumn("_bucket", F.substring("_order", 1, digits))
    buckets = docs.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sizes = buckets.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    offsets = offsets.select(F.col("o.source").alias("_source"), F.col("_bucket").alias("_b"), "_offset", "source_size", "target")
    offsets = saved(offsets, "offsets")  # of known size: Spark broadcasts it only if it is small
    x = docs.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - whole * F.col("source_size")
    x = x.withColumn("_ahead", ahead)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_ahead")))
    return x.withColumn("taken", (whole * F.col("size") + extra).cast("long"))


def mixing_plan(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``: its words, its source's words and target, and the
    words that the mix takes of it, repetitions counted. Texts are not shuffled."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return _planned(sized, weights, max_epochs, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself, in the columns of ``documents``: a row for each whole repetition, and for a fractional one a
    row whose text ends after the words taken. A document that the mix takes nothing of has no row."""
    x = docs.select("doc_id", "text", "lang", "source", "n_chars", n_words(F.col("text")).alias("size"))
    x = _planned(x, weights, max_epochs, seed).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    x = x.withColumn("_words", F.explode(copies))
    first = _first_words(F.col("text"), F.col("_words"))
    text = F.when(F.col("_words") > 0, first).otherwise(F.col("text"))
    n_chars = F.when(F.col("_words") > 0, F.length(first).cast("long")).otherwise(F.col("n_chars"))
    return x.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def _first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words with the white space between them as it stands."""
    parts = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")


ORACLE_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM sources),
filled AS (
  SELECT *, coalesce(CAST(sum(cap) OVER before AS BIGINT), 0) AS cap_before,
         CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER before AS BIGINT), 0) AS weight_left
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
clamped AS (SELECT *, (total - cap_before) * weight >= cap * weight_left AS is_clamped FROM filled),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * (total - coalesce(CAST(sum(cap) FILTER (is_clamped) OVER () AS BIGINT), 0)) AS DOUBLE)
                   / CAST(sum(weight) FILTER (NOT is_clamped) OVER () AS BIGINT) END AS target
  FROM clamped),
ordered AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
         coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
wholes AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM ordered)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, words - whole * source_size - ahead)) AS BIGINT) AS taken
FROM wholes
"""
