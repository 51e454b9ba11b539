"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight bytes at eight positions. Two fingerprints that differ in at most ``d`` bits share at least
``8 - d`` of their positional bytes (the guaranteed minimum of matches). The index lists, for every choice of that
many positions, the distinct fingerprints by the bytes they have there: a list holds exactly the fingerprints that
reach the minimum together, counted at those positions, and nothing that falls short of it. A list is bounded by
what the other ``d`` bytes can be (65,536 for two bits), however many documents there are, and holds fingerprints
once, however many copies a text has.

Within a list, candidates are verified by the bits in which they differ. Short lists compare every pair; for long
ones the values one bit away from each member are written down and members that meet in one are linked, so that a
dense list costs its length and not its square: two members differ by at most two bits exactly if some value is at
most one bit away from both. Links are a chain through such a meeting point; components need no more.

Nulls and corner cases: null and empty texts, and texts of white space, have the fingerprint zero and are linked
like any other; null doc_ids are kept and count as the largest in a component; rows that repeat a doc_id keep rows
of their own. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, give_back, saved

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text: a bit is set if it is in over half of the shingles' hashes."""
    found = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    hashes = np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[words - 1:].tolist())), np.uint64, len(starts))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # in blocks, to keep the bits of a long text small
        bits = np.unpackbits(hashes[k:k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(set_bits.tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, row, fp``: the fingerprint as a signed long; ``row`` tells rows that repeat a doc_id apart by text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words, seed) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row long, fp long")


def _linked(fps: np.ndarray, bits: int) -> np.ndarray:
    """Links (a, b) that join fingerprints differing in at most ``bits`` bits, enough for their components."""
    n = len(fps)
    if n <= 64 or bits != 2:
        a, b = np.triu_indices(n, 1)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        return np.stack([fps[a[near]], fps[b[near]]], axis=1)
    varies = np.bitwise_or.reduce(fps ^ fps[0])
    masks = np.array([0] + [1 << k for k in range(64) if int(varies) >> k & 1], np.uint64)
    meeting = (fps[:, None] ^ masks).ravel()
    member = np.repeat(fps, len(masks))
    order = np.argsort(meeting, kind="stable")
    meeting, member = meeting[order], member[order]
    same = meeting[1:] == meeting[:-1]
    return np.unique(np.stack([member[:-1][same], member[1:][same]], axis=1), axis=0)


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that differ in at most ``bits`` bits; every pair within
    that distance is joined by a path of links."""
    kept = 8 - bits
    masks = [sum(0xFF << 8 * p for p in at) for at in combinations(range(8), kept)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    index = distinct.select("fp", F.posexplode(F.transform(F.lit(signed), lambda m: m.bitwiseAND(F.col("fp")))).alias("at", "bytes"))
    lists = index.groupBy("at", "bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def verified(batches):
        for batch in batches:
            column = batch.column(0)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            found = [_linked(flat[x:y], bits) for x, y in zip(ends[:-1], ends[1:])]
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return lists.mapInArrow(verified, "a long, b long")


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """``doc_id, row, fp, component_id``: of each document its fingerprint and the smallest doc_id that links reach."""
    fps = saved(fingerprints(docs, words, seed), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), bits))
    firsts = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = firsts.join(ids, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("doc_id", "row", "fp", "component_id", "root")


def simhash_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """``docs`` without near-duplicates: of each component the document with the smallest doc_id stays, null ids
    last; of rows that repeat it, one."""
    group = simhash_groups(docs, words, bits, seed)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "row"))
    kept = group.groupBy("root").agg(first.alias("k")).select("k.id", "k.row")
    # joined and freed of repeated rows by the same keys: texts move once
    none = F.lit(0).cast(docs.schema["doc_id"].dataType)
    names = ["simhash_null", "simhash_key", "simhash_row"]
    keys = lambda i, row: [c.alias(n) for c, n in zip((i.isNull(), F.coalesce(i, none), row), names)]
    rows = docs.select("*", *keys(F.col("doc_id"), F.xxhash64("text"))).join(kept.select(*keys(F.col("id"), F.col("row"))), names, "left_semi")
    return rows.dropDuplicates(names).select(*docs.columns)
