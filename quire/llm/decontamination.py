"""Benchmark decontamination by one Aho-Corasick automaton over normalised test questions and answers.

Texts are normalised to words: A-Z are lower-cased and every run of ASCII digits, ASCII letters and non-ASCII characters is
a word. An item is its windows of ten consecutive words (a shorter item with a word is one window). The automaton holds all
windows; a text is normalised and scanned once, and every match is mapped back from words to code points of the original.

Words of the items are spelled with a few letters of small alphabets, one alphabet for each place, so that a match can't
begin inside a word; a word that no item has is a single mark, where the automaton falls back to its root.

The automaton is built in each task from pairs of window and item. Their number and bytes are counted first: where they
exceed ``MAX_PAIRS`` or ``MAX_BYTES``, they are dealt to blocks by a hash of the pair, and the documents are read once for
each block; what the blocks find is united for each text. So neither the driver nor a task ever holds more than a block.

Nulls and corner cases: a null or empty text has no words, whether document or item, and such an item has no window. Rows
with the same item id are one item with the windows of all; items without id are one item, spelled as an empty string.
Rows that repeat a doc_id or a whole document stay rows of their own. An empty benchmark hits nothing, an empty table of
documents gives no row. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved, text_bytes

#: Consecutive words in a window.
WINDOW = 10
#: Pairs of window and item, and bytes of their windows, in one automaton (about 150 MB in a task).
MAX_PAIRS, MAX_BYTES = 65_536, 32 << 20
#: What each byte of a text becomes: letters are lower-cased, ASCII digits and bytes of other characters stay, the rest
#: separates words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Letters of each place of a spelled word, and the mark of a word that no item has.
RADIX, UNKNOWN = 16, "\xff"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``words_of`` starts and ends in the text, in code points."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], np.frombuffer(text.translate(NORMAL), np.uint8) != 32, [False]])
    steps = np.flatnonzero(inside[1:] != inside[:-1])
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    return before[steps[0::2]], before[steps[1::2]]


class Automaton:
    """Windows given as ``(window, item)``, the words of a window separated by blanks."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        windows: dict[bytes, set[str]] = {}
        for w, item in pairs:
            windows.setdefault(w, set()).add(item)
        self.items = list(windows.values())
        vocabulary = sorted({w for window in windows for w in window.split()})
        places = 1
        while RADIX ** places < len(vocabulary):
            places += 1
        self.places = places
        self.spelling = {w: "".join(chr(32 + RADIX * p + k // RADIX ** p % RADIX) for p in range(places)) for k, w in enumerate(vocabulary)}
        self.lengths = []
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, window in enumerate(windows):
            spelled = [self.spelling[w] for w in window.split()]
            self.lengths.append(len(spelled))
            self.trie.add_word("".join(spelled), k)
        if windows:
            self.trie.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Numbers of the words inside any occurrence of a window, and the items that own these windows."""
        if not self.lengths or not words:
            return np.zeros(0, np.int64), set()
        spell = self.spelling.get
        spelled = [spell(w, UNKNOWN) for w in words]
        ends, which = [], []
        for end, k in self.trie.iter("".join(spelled)):
            ends.append(end)
            which.append(k)
        if not ends:
            return np.zeros(0, np.int64), set()
        stop = np.cumsum([len(s) for s in spelled])  # letters up to the end of each word
        last = np.searchsorted(stop, np.array(ends) + 1)
        first = last + 1 - np.array(self.lengths)[which]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, last + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0), set().union(*(self.items[k] for k in set(which)))


def windows_of(words: list[bytes], window: int = WINDOW) -> Iterator[bytes]:
    """The windows of an item, their words separated by blanks."""
    for k in range(max(1, len(words) - window + 1) if words else 0):
        yield b" ".join(words[k:k + window])


def item_windows(items: DataFrame, item_id: str = "item_id", texts: tuple[str, ...] = ("text",), window: int = WINDOW) -> DataFrame:
    """``item string, window binary``: the distinct windows of all items. ``texts`` name the columns that hold questions
    and answers; no window spans two of them."""
    def cut(batches):
        for batch in batches:
            for name in texts:
                data, at = text_bytes(batch.column(name))
                data = data.tobytes()
                ids = batch.column("item").to_pylist()
                for i, a, b in zip(ids, at[:-1], at[1:]):
                    found = list(set(windows_of(words_of(data[a:b]), window)))
                    for k in range(0, len(found), 10_000):
                        part = found[k:k + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.string()), pa.array(part, pa.binary())], names=["item", "window"])

    item = F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item")
    return items.select(item, *[F.col(t) for t in texts]).mapInArrow(cut, "item string, window binary").distinct()


def _scanned(docs: DataFrame, pairs: list[tuple[bytes, str]], spans: bool, only_hits: bool) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` scanned for the windows of one block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        automaton = Automaton(pairs)
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            data = data.tobytes()
            rows, n_words, hits, items, cut = [], [], [], [], []
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                text = data[a:b]
                words = words_of(text)
                hit, found = automaton.scan(words)
                if only_hits and not len(hit):
                    continue
                rows.append(k)
                n_words.append(len(words))
                hits.append(hit)
                items.append(sorted(found))
                cut.append(_spans(text, hit) if spans and len(hit) else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())) if only_hits else pa.nulls(len(rows), pa.string()),
                pa.array(n_words, pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array(hits if only_hits else [None] * len(hits), pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.string())), pa.array(cut, pa.list_(SPAN)),
            ], names=["doc_id", "text", "n_words", "n_hit", "hits", "items", "spans"])

    return docs.mapInArrow(scan, f"doc_id {kind}, text string, n_words long, n_hit long, hits array<long>, items array<string>, spans array<struct<start: long, end: long>>")


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of neighbouring hit words as code points of the text."""
    starts, ends = word_bounds(text)
    new = np.concatenate([[True], np.diff(hit) > 1])
    first, last = hit[new], hit[np.concatenate([new[1:], [True]])]
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[first], ends[last])]


def contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id", texts: tuple[str, ...] = ("text",), window: int = WINDOW,
                 max_pairs: int = MAX_PAIRS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` for each document: its words, those inside any occurrence of a window, the
    ids of the items that own these windows (strings, sorted) and the stretches of the original text that are hit
    (``start`` and ``end`` in code points)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    pairs = saved(item_windows(items, item_id, texts, window), "windows")
    n, size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    blocks = max(1, -(-n // max_pairs), -(-size // max_bytes))
    of_block = lambda b: [(bytes(r.window), r.item) for r in pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b).collect()]
    if blocks == 1:
        return _scanned(docs, of_block(0), spans=True, only_hits=False).drop("text", "hits")
    found = None
    for b in range(blocks):
        part = saved(_scanned(docs, of_block(b), spans=False, only_hits=True).drop("spans"), "hits")
        found = part if found is None else found.unionAll(part)
    return _united(docs, found)


def _united(docs: DataFrame, found: DataFrame) -> DataFrame:
    """What the blocks found of each text, joined to all documents by the text's digest."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    once = found.groupBy(text_key(F.col("text")).alias("key")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def located(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            data = data.tobytes()
            n_words, cut = [], []
            for a, b, hit in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(2).to_pylist()):
                n_words.append(len(words_of(data[a:b])))
                cut.append(_spans(data[a:b], np.array(hit)) if hit else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words, pa.int64()), pa.array([len(h or ()) for h in batch.column(2).to_pylist()], pa.int64()),
                pa.array([i or [] for i in batch.column(3).to_pylist()], pa.list_(pa.string())), pa.array(cut, pa.list_(SPAN)),
            ], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    joined = docs.withColumn("key", text_key(F.col("text"))).join(once, "key", "left").select("doc_id", "text", "hits", "items")
    return joined.mapInArrow(located, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


#: A-Z and a-z, for SQL that lower-cases ASCII letters only.
CASES = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {CASES}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {CASES}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[k + 1:k + {WINDOW}], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, k, array_to_string(w[k + 1:k + size], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS k FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT r, k, size, item_id FROM places JOIN windows USING (size, words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT r, k, size FROM found)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
