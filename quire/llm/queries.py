"""The registered queries of this subpackage and their SQL. Each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import ORACLE_DECONTAMINATION, contaminated
from .fim import ORACLE_FIM, fill_in_middle, restored
from .fingerprints import near_edited
from .licenses import license_scan, oracle_license
from .lines import ORACLE_LINES, without_boilerplate
from .manifest import ORACLE_MANIFEST, tampering_found
from .mixing import ORACLE_MIXING, mixing_plan
from .packing import packed
from .passages import repeated_passages
from .quality import quality
from .simhash import simhash_groups
from .suffixes import removed_substrings
from .warc import ORACLE_WARC, archived

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn
    return register


@query(oracle_license())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents state, by Dice over word bigrams."""
    return license_scan(table(spark, sf_dir, "documents"))


@query(ORACLE_WARC)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to a content-addressed archive and read back."""
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(ORACLE_MIXING)
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources by capped water-filling takes of each document."""
    return mixing_plan(table(spark, sf_dir, "documents"))


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by SimHash."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return near_edited(table(spark, sf_dir, "documents"))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenized and packed into sequences of 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"), with_ids=False)


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents and whether the trees fitted to the labels keep them."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(ORACLE_LINES)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand on ten sources or more."""
    return without_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 50-byte strings that an earlier document has."""
    return removed_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that an earlier document has too, edits included."""
    return repeated_passages(table(spark, sf_dir, "documents"))


@query(ORACLE_DECONTAMINATION)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in a window of a benchmark item, and the items."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query(ORACLE_MANIFEST)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of a Merkle manifest, proven against its root after some were tampered with."""
    return tampering_found(table(spark, sf_dir, "documents"))


@query(ORACLE_FIM)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at two ranks of their lines, rearranged, and restored."""
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
