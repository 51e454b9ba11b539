"""Suffix-array dedup: repeated passages by a depth-limited, most-significant-digit radix sort of suffixes.

Suffixes need only be told apart through their first ``depth`` bytes: groups of suffixes that are equal that far are
exactly the repeated windows. Three passes refine the groups, each over what the one before left:

1. *Sampled suffixes, first ``ANCHOR`` bytes.* In every window of ``depth`` bytes the position whose next ``ANCHOR``
   bytes have the least hash is an anchor (all such positions, for ties). Equal windows have equal anchors, so a
   window can only repeat where its anchor does. Digits of the anchors are compared over all documents, packed and
   distinct within a part, and each part learns by a bitmap which of its anchors another document has too.
2. *Records.* For the anchors left, a record holds the bytes around it that windows with that anchor span. Records
   are grouped whole: of equal ones, all but that of the smallest doc_id are repeated throughout.
3. *Windows.* Where an anchor has several different records, the windows of one record each are sorted by digits of
   eight bytes, most significant first; a window that is alone in its group leaves after each digit.

Documents are dealt to parts by a hash of their id, a part being about ``part_mb`` MB of text. Within a part, equal
records count once, so an anchor has at most one record of a kind for each part, however many copies there are. No
row holds more than a part; nothing is collected. All comparisons but the pruning of pass 1 are of the bytes
themselves.

Nulls and corner cases: a null text is empty; texts shorter than ``depth`` are never touched; a null doc_id counts as
larger than all others; rows that repeat a doc_id are documents of their own, none smaller than the other. An empty
table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, text_parts
from .parts import LAST, MESSAGE, alive_keys, blob, bucket_no, bucketed, compared, in_two, key_messages, message, runs_of, unblob

DEPTH, ANCHOR = 50, 32
PART_MB = 8
#: Bytes of a part that are hashed at a time.
BLOCK = 1 << 20
# Odd multipliers of the hash, and of its finish.
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n positions as one number; data goes on for seven bytes more."""
    out = np.empty((n + 7) // 8 * 8, np.uint64)
    for k in range(8):
        count = (len(data) - k) // 8
        own = np.frombuffer(data[k:k + count * 8].tobytes(), np.uint64)[:len(out) // 8]
        out[k::8][:len(own)] = own
    return out[:n]


def _mixed(h: np.ndarray, step: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULTIPLIERS[step % 4]
    return h ^ (h >> np.uint64(29))


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of a byte matrix whose width is a multiple of eight."""
    words = np.ascontiguousarray(rows).view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        h = _mixed(h + words[:, k], k)
    return _mixed(h * MULTIPLIERS[4], 1)


def _least(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Of each run of ``width`` values the least (or what ``pick`` picks)."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[:len(x) - (width - span)], x[width - span:]) if span < width else x


def anchors(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows within the documents ``data[at[i]:at[i + 1]]``."""
    width = depth - ANCHOR + 1  # places that an anchor may have in a window
    ends = np.repeat(at[1:], np.diff(at)) if len(at) < len(data) // 64 else None
    pad = np.concatenate([data, np.zeros(depth + ANCHOR, np.uint8)])
    found, hashes = [], []
    for first in range(0, len(data), BLOCK):
        last = min(first + BLOCK, len(data))  # windows that start here
        n = last - first + width - 1
        w = _words(pad[first:first + n + ANCHOR], n + ANCHOR - 8)
        h = np.zeros(n, np.uint64)
        for k in range(0, ANCHOR, 8):
            h = _mixed(h + w[k:k + n], k // 8)
        order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        low = _least(order, width)
        end = ends[first:last] if ends is not None else at[np.searchsorted(at, np.arange(first, last), side="right")]
        low[np.arange(first, last) + depth > end] = 0
        edge = np.zeros(width - 1, np.uint32)
        top = _least(np.concatenate([edge, low, edge]), width, np.maximum)
        own = np.flatnonzero(top == order)
        found.append(own + first)
        hashes.append(h[own])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where, one = np.unique(np.concatenate(found), return_index=True)  # blocks share anchors at their edges
    return where, np.concatenate(hashes)[one]


@dataclass
class Part:
    """The documents of a part in the order of their ids, and their anchors by key (bucket, then hash bits)."""

    table: pa.Table
    ids: np.ndarray
    data: np.ndarray
    at: np.ndarray
    where: np.ndarray
    doc: np.ndarray
    keys: np.ndarray
    kind: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, depth: int, buckets: int) -> Part:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        ids = table["doc_id"].cast(pa.int64()).fill_null(LAST).to_numpy()
        data, at = text_bytes(table["text"])
        where, h = anchors(data, at, depth)
        keys, kind = np.unique(bucketed(h, buckets), return_inverse=True)
        return cls(table, ids, data, at, where, np.searchsorted(at, where, side="right") - 1, keys, kind)

    def shared_here(self) -> np.ndarray:
        """Keys that two documents of this part have."""
        return in_two(self.kind, self.ids[self.doc], len(self.keys))


@dataclass
class Records:
    """The records of a part's anchors that another document has: ``one`` has of each kind the first occurrence."""

    where: np.ndarray
    doc: np.ndarray
    kind: np.ndarray
    one: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, part: Part, alive: np.ndarray, depth: int) -> Records:
        """``alive``: which of the part's keys are left. A row is the bytes from ``depth - ANCHOR`` before the anchor
        to ``depth`` after it, then how many of them lie before and after it in the document, filled up to eights."""
        left = depth - ANCHOR
        use = np.flatnonzero(alive[part.kind])
        use = use[np.argsort(part.kind[use], kind="stable")]
        where, doc = part.where[use], part.doc[use]
        pad = np.concatenate([np.zeros(left, np.uint8), part.data, np.zeros(depth, np.uint8)])
        before = np.minimum(where - part.at[doc], left)
        after = np.minimum(part.at[doc + 1] - where, depth)
        rows = np.zeros((len(use), -(-(left + depth + 2) // 8) * 8), np.uint8)
        rows[:, :left + depth] = np.lib.stride_tricks.sliding_window_view(pad, left + depth)[where] if len(use) else 0
        place = np.arange(left + depth) - left
        rows[:, :left + depth][(place < -before[:, None]) | (place >= after[:, None])] = 0
        rows[:, left + depth], rows[:, left + depth + 1] = before, after
        one, kind = equal_rows(rows, part.ids[doc], part.kind[use])
        return cls(where, doc, kind, one, rows)


def equal_rows(rows: np.ndarray, ids: np.ndarray, major: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each kind of row the one with the smallest id (kinds in the order of ``major``, if given), and each row's
    kind."""
    h = _hash_rows(rows) if len(rows) else np.zeros(0, np.uint64)
    order = np.lexsort((ids, h) if major is None else (ids, h, major))
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def repeated_windows(rows: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Which windows of each record also start in a document with a smaller id: bit j is that of the window that
    starts j bytes before the anchor."""
    left = depth - ANCHOR
    every = np.zeros(len(rows), np.uint32)
    before, after = rows[:, left + depth].astype(np.int64), rows[:, left + depth + 1].astype(np.int64)
    one, kind = equal_rows(rows, ids)
    first = ids[one][kind]
    # the others of a kind are repeated throughout
    span = [np.where((before >= j) & (after >= depth - j), np.uint32(1 << j), np.uint32(0)) for j in range(left + 1)]
    out = np.where(ids > first, np.bitwise_or.reduce(span), every) if len(rows) else every
    # kinds that share an anchor
    head, ids1 = rows[one], ids[one]
    anchor = equal_rows(np.ascontiguousarray(head[:, left:left + ANCHOR]), ids1)[1]
    several = np.flatnonzero(np.bincount(anchor)[anchor] > 1) if len(one) else one
    wide = np.concatenate([head, np.zeros((len(head), 8), np.uint8)], axis=1)
    for j in range(left + 1):
        alive = several[(before[one][several] >= j) & (after[one][several] >= depth - j)]
        group = anchor[alive]
        for k in range(0, depth, 8):
            if not len(alive):
                break
            digit = np.ascontiguousarray(wide[alive, left - j + k:left - j + k + 8]).view(np.uint64).ravel()
            if k + 8 > depth:
                digit = digit & np.uint64((1 << 8 * (depth - k)) - 1)
            order = np.lexsort((digit, group))
            new = np.ones(len(alive), bool)
            new[1:] = (group[order[1:]] != group[order[:-1]]) | (digit[order[1:]] != digit[order[:-1]])
            number = np.cumsum(new) - 1
            size = np.bincount(number)
            stay = size[number] > 1  # a suffix alone in its group is told apart
            alive, group = alive[order[stay]], number[stay]
        if len(alive):
            low = np.full(group.max() + 1, LAST)
            np.minimum.at(low, group, ids1[alive])
            hit = alive[ids1[alive] > low[group]]
            out[one[hit]] |= np.uint32(1 << j)
    return out


def removed_substrings(docs: DataFrame, depth: int = DEPTH, part_mb: int = PART_MB) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans``: each document's bytes without those covered
    by a string of ``depth`` bytes that also starts in a document with a smaller doc_id. ``spans`` lists the removed
    runs as (start, length); ``kept`` are the remaining bytes."""
    if not ANCHOR <= depth <= ANCHOR + 31:
        raise ValueError(f"depth must be {ANCHOR} to {ANCHOR + 31}")
    parts = text_parts(docs, mb=part_mb)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # part, id and text, in one exchange that all passes use
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), "doc_id", F.xxhash64("text").alias("row"), "text")

    def sampled(table: pa.Table) -> pa.Table:
        part = Part.of(table, depth, parts)
        return key_messages(table["part"][0].as_py(), part.keys, part.shared_here())

    def recorded(table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows or not messages.num_rows:
            return message([], [], "records", [], [])
        part, own = Part.of(table, depth, parts), table["part"][0].as_py()
        r = Records.of(part, alive_keys(part.keys, messages), depth)
        ids, bucket = part.ids[r.doc[r.one]], bucket_of(part, r)
        spans = runs_of(bucket)
        bodies = [ids[s].tobytes() + blob(r.rows[r.one[s]]) for s in spans]
        return message([own] * len(spans), [int(bucket[s.start]) for s in spans], "records", [s.stop - s.start for s in spans], bodies)

    def bucket_of(part: Part, r: Records) -> np.ndarray:
        """The bucket of each kind of record; kinds are in the order of their keys."""
        return bucket_no(part.keys)[part.kind[np.searchsorted(part.where, r.where[r.one])]]

    def sorted_out(table: pa.Table) -> pa.Table:
        n, bodies, own = table["n"].to_pylist(), table["body"].to_pylist(), table["part"].to_pylist()
        ids = np.concatenate([np.frombuffer(b, np.int64, k) for k, b in zip(n, bodies)])
        rows = np.concatenate([unblob(b[8 * k:], np.uint8).reshape(k, -1) for k, b in zip(n, bodies)])
        masks = repeated_windows(rows, ids, depth)
        ends = np.cumsum(n)
        return message(own, [table["bucket"][0].as_py()] * len(n), "masks", n, [blob(masks[e - k:e]) for k, e in zip(n, ends)])

    def cut(table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f: pa.array([], t) for f, t in zip(columns, types(table))})
        part = Part.of(table, depth, parts)
        starts = np.zeros(len(part.data) + 1, np.int8)
        if messages.num_rows:
            r = Records.of(part, alive_keys(part.keys, messages), depth)
            masks, bucket = np.zeros(len(r.one), np.uint32), bucket_of(part, r)
            m = messages.filter(pc.equal(messages["kind"], "masks"))
            for b, body in zip(m["bucket"].to_pylist(), m["body"].to_pylist()):
                a, z = np.searchsorted(bucket, [b, b + 1])
                masks[a:z] = unblob(body, np.uint32)
            first = part.ids[r.doc[r.one]][r.kind]
            later = part.ids[r.doc] > first
            for j in range(depth - ANCHOR + 1):
                inside = (r.where - j >= part.at[r.doc]) & (r.where - j + depth <= part.at[r.doc + 1])
                starts[r.where[inside & (later | (masks[r.kind] >> np.uint32(j) & 1).astype(bool))] - j] = 1
        return pa.table(dict(zip(columns, (pa.array(c, t) if not isinstance(c, pa.ChunkedArray) else c for c, t in zip(kept(part, starts), types(table))))))

    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]

    def types(table: pa.Table) -> list:
        return [table.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]

    def kept(part: Part, starts: np.ndarray) -> list:
        out: list = [[] for _ in columns[1:]]
        for a, z in zip(part.at[:-1], part.at[1:]):
            own = part.data[a:z]
            runs = _runs(starts[a:z], depth)
            rest = own
            if len(runs):
                steps = np.zeros(len(own) + 1, np.int8)
                steps[runs[:, 0]] += 1
                steps[runs[:, 1]] -= 1
                rest = own[np.cumsum(steps[:-1], dtype=np.int8) == 0]
            body = rest.tobytes()
            row = (len(own), len(own) - len(body), len(runs), hashlib.sha256(body).hexdigest(), body, [[int(s), int(e - s)] for s, e in runs])
            for c, v in zip(out, row):
                c.append(v)
        return [part.table["doc_id"], *out]

    keys = dealt.groupBy("part").applyInArrow(sampled, MESSAGE)
    alive = keys.groupBy("bucket").applyInArrow(compared, MESSAGE)
    records = dealt.groupBy("part").cogroup(alive.groupBy("part")).applyInArrow(recorded, MESSAGE)
    masks = records.groupBy("bucket").applyInArrow(sorted_out, MESSAGE)
    return dealt.groupBy("part").cogroup(alive.unionAll(masks).groupBy("part")).applyInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")


def _runs(starts: np.ndarray, depth: int) -> np.ndarray:
    """Maximal runs of bytes (start, end) covered by windows that start where marked."""
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-depth - 1) > depth)
    last = np.append(new[1:], len(at)) - 1
    return np.stack([at[new], at[last] + depth], axis=1)
