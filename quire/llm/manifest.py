"""Merkle manifest of a dataset with a witness for every row, grown by incremental witnesses.

Leaves are appended in order. Three consecutive nodes complete a run and become their hash, a node of the next level; the
last run of a level may hold fewer. While a subtree is open, each leaf beneath it has a partial witness; when a later sibling
completes the run, the witnesses of all leaves in the run are extended by their siblings. Witnesses are thus final when the
last run closes, and no tree is ever held whole.

A tree (a source) of any size is spread: its leaves are ranked without a window over the source (a range sort, running row
numbers within tasks, counts of the tasks added up), cut into aligned blocks of ``BLOCK`` leaves, and a task appends the
leaves of a block as a stream. Roots of the blocks are the leaves of the next round's appends, until each tree has one node; then the
roots of the trees are appended likewise to give the root of all. What a block's root collects in later rounds extends the
witnesses of its leaves, joined by (tree, block), so that no join key has more than ``BLOCK`` rows however large a tree is.

A witness is a sequence of levels: one byte, place in the run plus 4 times the number of siblings, then their digests.

Nulls and corner cases: nulls in any column are part of the leaf (``-``); rows of a null source are a tree of their own,
which comes first; null ids come first in their tree, and rows that repeat an id are ordered by leaf. A tree of one row is its leaf.
An empty table has no row and no root. Rows that are equal in everything are equal leaves, one after the other.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Nodes in a run, and the levels and leaves of a block.
ARITY, LEVELS = 3, 7
BLOCK = ARITY ** LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(digests: list[bytes]) -> bytes:
    """The digest of a run: sha256 over the digests as lower-case hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def leaf_digest(columns) -> Column:
    """Lower-case hex sha256 of a row's values, each preceded by its byte count and a colon; a null is ``-``."""
    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*[field(F.col(c) if isinstance(c, str) else c) for c in columns]), 256)


class Appender:
    """One block: digests appended in order, witnesses extended whenever a run is complete."""

    def __init__(self):
        self.open: list[list[tuple[bytes, int, int]]] = [[]]  # by level: nodes of the open run, with the leaves beneath them
        self.witnesses: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        n = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._attach(0, (digest, n, n + 1))

    def _attach(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for k, (_, first, stop) in enumerate(run):
            step = bytes([k + 4 * (len(run) - 1)]) + b"".join(digests[:k] + digests[k + 1:])
            for i in range(first, stop):
                self.witnesses[i] += step
        self._attach(level + 1, (hashed(digests), run[0][1], run[-1][2]))

    def close(self, levels: int) -> bytes:
        """Complete what is open up to so many levels; the node that remains."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def levels_of(total: int) -> int:
    """The levels of a block in a tree of ``total`` nodes: all of them if there are more blocks than one."""
    levels = 0
    while levels < LEVELS and ARITY ** levels < total:
        levels += 1
    return levels


def folded(digest: bytes, witness: bytes, size: int = 32) -> bytes:
    """The root that a digest and its witness lead to."""
    at = 0
    while at < len(witness):
        place, n = witness[at] & 3, witness[at] >> 2
        others = [witness[at + 1 + size * k:at + 1 + size * (k + 1)] for k in range(n)]
        digest = hashed(others[:place] + [digest] + others[place:])
        at += 1 + size * n
    return digest


def siblings(witness: bytes, size: int = 32) -> bytes:
    """All digests of a witness one after the other."""
    out, at = [], 0
    while at < len(witness):
        n = witness[at] >> 2
        out.append(witness[at + 1:at + 1 + size * n])
        at += 1 + size * n
    return b"".join(out)


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes(_tree, ...)`` with ``_rank`` within the tree by ``order`` and ``_total``, the nodes of the tree. The rows
    are laid out by a range sort, which reads its input twice and so begins at a saved table; a task's rows of a tree begin after
    those of all earlier tasks."""
    nodes = saved(nodes, "nodes")
    laid = nodes.repartitionByRange("_tree", *order).sortWithinPartitions("_tree", *order).withColumn("_at", F.monotonically_increasing_id())
    laid = saved(laid, "ranked")
    task = F.shiftright("_at", 33).alias("_task")
    runs = laid.groupBy(task, "_tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = saved(runs, "runs")  # a row for each task and tree
    totals = runs.groupBy("_tree").agg(F.sum("_n").alias("_total"))
    before = _running(runs)
    places = before.join(totals, "_tree").select("_tree", "_task", (F.col("_before") - F.col("_first")).alias("_shift"), "_total")
    return laid.withColumn("_task", task).join(places, ["_tree", "_task"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _running(runs: DataFrame) -> DataFrame:
    """``_before``: the nodes of a tree in earlier tasks. A window over a tree's tasks, which are one for each partition
    of the range sort."""
    w = Window.partitionBy("_tree").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def _appended(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes(_tree, _rank, _total, _digest, ...)`` appended, a table with two kinds of rows: the nodes with
    ``_block`` and their partial ``_witness``, and for each block its root, with no ``_witness``."""
    nodes = nodes.withColumn("_block", F.floor(F.col("_rank") / BLOCK).cast("long"))
    laid = nodes.repartition("_tree", "_block").sortWithinPartitions("_tree", "_block", "_rank")
    fields = laid.schema
    at = {c: k for k, c in enumerate(laid.columns)}

    def append(batches):
        held: list[pa.RecordBatch] = []  # rows whose block is open
        block, appender, done, roots = None, None, [], []

        def close():
            tree, number, total = block
            roots.append((tree, number, -(-total // BLOCK), appender.close(levels_of(total))))
            done.extend(map(bytes, appender.witnesses))

        def closed_rows():
            nonlocal held, done, roots
            if not roots:
                return
            rows = pa.Table.from_batches(held)
            out = rows.slice(0, len(done)).append_column("_witness", pa.array(done, pa.binary()))
            held = rows.slice(len(done)).to_batches()
            yield from out.combine_chunks().to_batches()
            tree, number, total, digest = zip(*roots)
            given = {"_tree": pa.array(tree, pa.string()), "_rank": pa.array(number, pa.int64()), "_total": pa.array(total, pa.int64()), "_digest": pa.array(digest, pa.binary())}
            yield pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(len(roots), f.type)).cast(f.type) for f in out.schema], schema=out.schema)
            done, roots = [], []

        for batch in batches:
            held.append(batch)
            columns = (batch.column(at[c]).to_pylist() for c in ("_tree", "_block", "_total", "_digest"))
            for tree, number, total, digest in zip(*columns):
                if block is None or block[:2] != (tree, number):
                    if block is not None:
                        close()
                    block, appender = (tree, number, total), Appender()
                appender.append(digest)
            yield from closed_rows()
        if block is not None:
            close()
            yield from closed_rows()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return saved(laid.mapInArrow(append, f"{kinds}, _witness binary"), "appended")


def grown(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes(_tree, _rank, _total, _digest, ...)``: the nodes with ``_block`` and a partial ``_witness``, and
    ``_tree, _block, _above, _root`` for each block: what extends the witnesses to the top, and the root of the tree."""
    most = nodes.agg(F.max("_total")).first()[0] or 0
    rounds = []
    while True:
        rounds.append(_appended(nodes))
        roots = rounds[-1].where("_witness IS NULL").select("_tree", "_rank", "_total", "_digest")
        most = -(-most // BLOCK)
        if most <= 1:
            break
        nodes = roots
    above = roots.select("_tree", F.col("_rank").alias("_block"), F.lit(b"").alias("_above"), F.col("_digest").alias("_root"))
    for later in reversed(rounds[1:]):
        rows = later.where("_witness IS NOT NULL").select("_tree", "_block", "_rank", "_witness")
        above = rows.join(above, ["_tree", "_block"]).select("_tree", F.col("_rank").alias("_block"), F.concat("_witness", "_above").alias("_above"), "_root")
    return rounds[0].where("_witness IS NOT NULL"), above


def manifest(rows: DataFrame, tree: str, order: list[str], digest: str = "leaf") -> DataFrame:
    """``rows`` (whose column ``digest`` is lower-case hex) with ``subroot``, ``root`` and ``witness``. Every distinct value
    of ``tree`` is a tree with the rows as leaves in ascending ``order``, ties by digest; the roots of the trees,
    ordered by its bytes with null first, are the leaves of the tree on top."""
    names = rows.columns
    # the key orders like the column's bytes, with null before the empty string
    keyed = rows.withColumn("_tree", F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))).withColumn("_digest", F.unhex(F.col(digest)))
    leaves, above = grown(ranked(keyed, [*order, "_digest"]))
    above = saved(above, "above")
    tops = above.groupBy(F.col("_tree").alias("_name")).agg(F.first("_root").alias("_digest"))  # equal for all blocks of a tree
    top_nodes, top_above = grown(ranked(tops.withColumn("_tree", F.lit("")), ["_name"]))
    top = top_nodes.join(top_above, ["_tree", "_block"]).select(F.col("_name").alias("_tree"), F.concat("_witness", "_above").alias("_top"), F.col("_root").alias("_all"))
    whole = above.join(top, "_tree").select("_tree", "_block", F.concat("_above", "_top").alias("_above"), F.col("_root").alias("_subroot"), "_all")
    hex_ = lambda c: F.lower(F.hex(c))
    return leaves.join(whole, ["_tree", "_block"]).select(
        *names, hex_("_subroot").alias("subroot"), hex_("_all").alias("root"), F.concat("_witness", "_above").alias("witness"))


def proven(found: DataFrame, digest: str = "leaf") -> DataFrame:
    """``found`` of ``manifest`` with ``proof_sha256``, the hash of the witness, and ``folded_root``, the root that the
    digest in this column and the witness lead to."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "witness")
    at, claim = found.columns.index("witness"), found.columns.index(digest)

    def prove(batches):
        for batch in batches:
            witnesses = batch.column(at).to_pylist()
            proofs = [hashlib.sha256(siblings(w).hex().encode()).hexdigest() for w in witnesses]
            roots = [folded(bytes.fromhex(d), w).hex() for d, w in zip(batch.column(claim).to_pylist(), witnesses)]
            kept = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(proofs, pa.string()), pa.array(roots, pa.string())],
                                             names=[*(batch.schema.names[k] for k in kept), "proof_sha256", "folded_root"])

    return found.mapInArrow(prove, f"{kinds}, proof_sha256 string, folded_root string")


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line breaks where 2 divides the CRC-32 of the decimal id."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def tampering_found(docs: DataFrame) -> DataFrame:
    """Documents as leaves of a manifest, some of them tampered with afterwards: ``doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified``; a row whose tampered text differs no longer leads to the root."""
    changed = [tampered_text(F.col("doc_id"), F.col("text")) if c == "text" else c for c in COLUMNS]
    # the second digest is computed only where the text may differ
    leaf = leaf_digest(COLUMNS)
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest(changed)).alias("_changed"))
    rows = rows.select("doc_id", "source", "leaf", F.coalesce("_changed", "leaf").alias("_claim"))
    found = proven(manifest(rows, "source", ["doc_id"]), "_claim")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_fields(text: str) -> str:
    value = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return " || ".join(value(text if c == "text" else c) for c in COLUMNS)


#: DuckDB has no CRC-32: the table of its 256 entries is made by eight divisions each.
ORACLE_MANIFEST = f"""
WITH RECURSIVE steps AS (
  SELECT n, n AS c, 0 AS s FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, s + 1 FROM steps WHERE s < 8),
crc_table AS (SELECT list(c ORDER BY n) AS entries FROM steps WHERE s = 8),
docs AS (
  SELECT row_number() OVER () AS r, *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda crc, d: xor(entries[xor(crc, d) % 256 + 1], crc >> 8)) % 2 AS odd
  FROM documents CROSS JOIN crc_table),
leaves AS (
  SELECT r, doc_id, source, sha256({_sql_fields("text")}) AS leaf,
    CASE WHEN odd = 1 THEN sha256({_sql_fields("replace(text, chr(10), '')")}) ELSE sha256({_sql_fields("text")}) END AS claim
  FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM leaves),
levels AS (
  SELECT source, 0 AS lvl, list(leaf ORDER BY k) AS l FROM placed GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], ''))) FROM levels WHERE len(l) > 1),
subroots AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS j FROM levels WHERE len(l) = 1),
tops AS (
  SELECT 0 AS lvl, list(subroot ORDER BY j) AS l FROM subroots
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], ''))) FROM tops WHERE len(l) > 1),
runs AS (
  SELECT r, lvl, k // CAST(pow(3, lvl) AS BIGINT) AS spot, l FROM placed JOIN levels ON placed.source IS NOT DISTINCT FROM levels.source AND len(l) > 1
  UNION ALL
  SELECT r, 1000 + lvl, j // CAST(pow(3, lvl) AS BIGINT), l FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source CROSS JOIN tops WHERE len(l) > 1),
paths AS (
  SELECT r, list(struct_pack(before := array_to_string(l[spot // 3 * 3 + 1:spot], ''), after := array_to_string(l[spot + 2:spot // 3 * 3 + 3], '')) ORDER BY lvl) AS path
  FROM runs GROUP BY r)
SELECT *, folded_root = root AS verified FROM (SELECT doc_id, leaf, subroot, (SELECT l[1] FROM tops WHERE len(l) = 1) AS root,
  sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s.before || s.after), '')) AS proof_sha256,
  list_reduce(list_prepend(claim, list_transform(coalesce(path, []), lambda s: s.before || ',' || s.after)),
    lambda h, s: sha256(split_part(s, ',', 1) || h || split_part(s, ',', 2))) AS folded_root
FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source LEFT JOIN paths USING (r))
"""
