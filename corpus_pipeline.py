"""The corpus pipeline: STAGES are applied one after the other to ``documents``, each to all rows that the stage
before it kept, written as a table and read again. All but the last return the columns of ``documents``.

1. *quality*: documents that the quality rules reject go.
2. *lines*: boilerplate lines go from the texts; every document stays.
3. *near_duplicates*: of each SimHash component the document with the smallest doc_id stays.
4. *mix*: sources are mixed to their target weights; a document has a row for each repetition, a fractional one with
   the words that it takes.
5. *pack*: what the mix has is tokenized and packed; a row is a piece of a document in a sequence.

SQL can express neither the trees of the first stage nor the tokenizer of the last, so there is no ORACLE_SQL; tests
hold each stage against a brute-force version.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.llm.common import saved, table  # noqa: E402
from quire.llm.lines import without_boilerplate  # noqa: E402
from quire.llm.mixing import mixed_documents  # noqa: E402
from quire.llm.packing import packed  # noqa: E402
from quire.llm.quality import quality_filter  # noqa: E402
from quire.llm.simhash import simhash_dedup  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = without_boilerplate(docs.select(COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup(docs.select(COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs).select(COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, with_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole corpus."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
