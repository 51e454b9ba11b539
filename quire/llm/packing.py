"""Cost-balanced packing of tokenized documents into sequences.

Training on a piece of n tokens costs about ``LINEAR n + QUADRATIC n^2``: a linear part for the layers and a quadratic
one for attention within the piece. Documents are dealt at random but repeatably to groups of bounded size; in a
group a long document first fills whole sequences, and what remains of the documents is assigned in descending order
of length to the sequence with the lowest cost so far among those with room for it. Where none has room it is cut and
fills the sequences of lowest cost one after the other.

A group opens as many sequences as its tokens fill, and for the rest sequences of sizes that are powers of two, which
need no padding either; so no sequence is padded.

Tokens are found by the tokenizer over words between white space, which its pre-tokenizer never joins; the ids of a
word are looked up once for a block of documents. Ids travel as 16-bit numbers where the vocabulary allows.

Nulls and corner cases: a null or empty text is one piece with the closing id alone; rows that repeat a doc_id are
packed as documents of their own; an empty table gives no piece. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, text_parts

SEQUENCE_TOKENS = 2048
CLOSING_ID = 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: MB of text in a group of documents that are packed together.
GROUP_MB = 16
#: Words whose ids a Python worker keeps (about 120 MB); beyond that it starts afresh.
KNOWN_WORDS = 600_000
#: MB of text that reach a Python worker at once.
BATCH_MB = 8
#: White space that separates words for any pre-tokenizer that drops white space, and what only Python's split()
#: counts as white space.
SPACE, NOT_SPACE = re.compile("[ \t\n\r]+"), re.compile("[\x1c-\x1f]")
#: Composed letters of Latin scripts followed by ASCII marks: two tokens apart for any pre-tokenizer that splits letters from
#: other characters.
LETTERS_MARKS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\\[-`{-~]*)")


def byte_alphabet() -> str:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order
    from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for; ``new`` lists them."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Words:
    """Ids of texts, word by word. The ids of word k are ``ids[at[k]:at[k + 1]]``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.lower = self.each(["AZ", "É"]) == self.each(["az", "é"])
        # lower-case letters reach the model as their bytes, if the tokenizer has neither prefix nor other spelling
        self.alphabet = {k: c for k, c in enumerate(byte_alphabet())}
        sample = ["a", "the", "unbelievable", "qzxjkvw", "é", "straße", "señorœ", "ǿđħ"]
        self.direct = self.lower and bool(self.ends.any()) and self.each(sample) == [self.spelled(w) for w in sample]
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``CLOSING_ID``, and where each text starts (one more at the end)."""
        if len(self.known) > KNOWN_WORDS:
            self.clear()
        numbers = array("q")
        number = self.known.__getitem__
        for t in texts:
            numbers.extend(map(number, SPACE.split(t) if NOT_SPACE.search(t) else t.split()))
            numbers.append(-1)  # the closing id stands as one more word
        if self.known.new:
            self.learn()
        numbers = np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)
        ends = np.flatnonzero(numbers == -1)
        size = np.where(numbers < 0, 1, self.at[numbers + 1] - self.at[numbers])
        stop = np.cumsum(size)
        source = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.at[numbers] - stop + size, size)
        closing = stop[ends] - 1
        source[closing] = 0
        out = self.ids[source] if len(self.ids) else np.zeros(len(source), np.uint32)
        out[closing] = CLOSING_ID
        return out, np.concatenate([[0], closing + 1])

    def learn(self) -> None:
        """The ids of the words that are new. A word of plain letters and closing marks is looked up as two parts, which are
        tokens apart, any other word as a whole. Letters go to the tokenizer's model itself where it takes them as they are,
        otherwise they are tokenized by the thousand, as one text."""
        known, new = self.known, self.known.new
        known.new = []
        old = len(known) - len(new)
        parts = [self.parts(w) for w in new]
        wanted = {p for ps in parts for p in ps}
        found: dict[str, list[int]] = {}
        for p in wanted:
            k = known.get(p, old)
            if k < old:
                found[p] = self.ids[self.at[k]:self.at[k + 1]].tolist()
        fresh = [p for p in wanted if p not in found]
        letters = [p for p in fresh if p.isalpha() and p.lower() == p and LETTERS_MARKS.fullmatch(p)]
        if self.direct:
            found.update((p, self.spelled(p)) for p in letters)
        else:
            for k in range(0, len(letters), 1000):
                found.update(zip(letters[k:k + 1000], self.joined(letters[k:k + 1000])))
        rest = [p for p in fresh if p not in found]
        for k in range(0, len(rest), 1000):
            found.update(zip(rest[k:k + 1000], self.each(rest[k:k + 1000])))
        ids = [found[ps[0]] if len(ps) == 1 else found[ps[0]] + found[ps[1]] for ps in parts]
        for p in fresh:  # for the words that share it
            if p not in known:
                known[p] = len(known)
                ids.append(found[p])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(list(map(len, ids)))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32)])

    def parts(self, word: str) -> tuple[str, ...]:
        """What is tokenized apart in a word. Letters and marks are only where the letters stay letters in the tokenizer's
        spelling: the lower case of some is a letter and a mark that joins what follows."""
        found = LETTERS_MARKS.fullmatch(word)
        if not found:
            return (word,)
        core, tail = found.groups()
        if self.lower:
            core = core.lower()
            if not (core.isascii() or core.isalpha()):
                return (word,)
        return (core, tail) if tail else (core,)

    def spelled(self, word: str) -> list[int]:
        """The ids of lower-case letters, from the tokenizer's model itself."""
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet))]

    def each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[list[int]]:
        """Words of letters; the tokenizer says by a token's ending where a word ends. If it sees more words in them
        than there are, each is tokenized by itself."""
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self.each(words)
        return [ids[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]


def words_of_worker(path: str) -> Words:
    """The table of this Python worker, which serves many tasks: each goes on with what earlier ones have learned. Functions
    travel by value, so the table hangs on a module that stays imported."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_tables_by_path", {})
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def assigned(lengths: list[int], capacity: int = SEQUENCE_TOKENS) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one group's documents, given in descending length."""
    sequence, rest = 0, []
    for k, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            yield k, start, capacity, sequence, 0
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, k, n - n % capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rest)
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    full = list(room)
    open_ones = [(0.0, s) for s in range(len(room))]  # by cost, then number
    for n, k, start in rest:
        aside = []
        while open_ones and room[open_ones[0][1]] < n:
            aside.append(heapq.heappop(open_ones))
        pieces = []
        if open_ones:
            cost, s = heapq.heappop(open_ones)
            pieces.append((cost, s, n))
        else:  # no sequence has room: cut
            left = n
            while left:
                cost, s = aside.pop(0)
                pieces.append((cost, s, min(left, room[s])))
                left -= pieces[-1][2]
        for x in aside:
            heapq.heappush(open_ones, x)
        for cost, s, m in pieces:
            yield k, start, m, sequence + s, full[s] - room[s]
            start += m
            room[s] -= m
            if room[s]:
                heapq.heappush(open_ones, (cost + LINEAR * m + QUADRATIC * m * m, s))


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE_TOKENS, group_mb: int = GROUP_MB, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``: the pieces of all documents with their
    token ids (not built unless ``with_ids``). ``sequence_id`` numbers sequences within groups (group * 2^32 + number)."""
    spark = docs.sparkSession
    bounded_batches(spark, BATCH_MB)
    path = tokenizer or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    groups = text_parts(docs, mb=group_mb)

    def tokenized(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words = words_of_worker(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for part in _blocks(texts):
                ids, at = words.texts([texts[i] for i in part])
                small = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
                cells = [small[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                rows = batch.slice(part.start, len(part))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(at)), pa.array(cells, pa.binary())], names=["doc_id", "_group", "n", "ids"])
        give_back()

    def pack(t: pa.Table) -> pa.Table:
        n, ids, doc = t["n"].to_pylist(), t["ids"].to_pylist(), t["doc_id"].to_pylist()
        order = sorted(range(t.num_rows), key=lambda i: (-n[i], doc[i] is None, doc[i] or 0, ids[i]))
        group = t["_group"][0].as_py()
        found = [(order[k], a, m, s, o) for k, a, m, s, o in assigned([n[i] for i in order], capacity)]
        which, start, length, sequence, offset = (list(c) for c in zip(*found))
        pieces, checks = [], []
        for i, a, m in zip(which, start, length):
            w = len(ids[i]) // n[i]
            piece = np.frombuffer(ids[i], f"<u{w}")[a:a + m].astype("<u4").tobytes()
            checks.append(zlib.crc32(piece))
            if with_ids:
                pieces.append(piece)
        return pa.table({
            "doc_id": t["doc_id"].take(pa.array(which)), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            **({"ids": pa.array(pieces, pa.binary())} if with_ids else {}),
            "ids_crc32": pa.array(checks, pa.int64()), "doc_tokens": pa.array([n[i] for i in which], pa.int64()),
            "sequence_id": pa.array([(group << 32) + s for s in sequence], pa.int64()), "offset": pa.array(offset, pa.int64())})

    dealt = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(groups)).cast("long").alias("_group"), "text")
    tokens = dealt.mapInArrow(tokenized, f"doc_id {kind}, _group long, n long, ids binary")
    ids_field = "ids binary, " if with_ids else ""
    return tokens.groupBy("_group").applyInArrow(pack, f"doc_id {kind}, start long, length long, {ids_field}ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _blocks(texts: list[str], chars: int = 1 << 20) -> Iterator[range]:
    """Ranges of texts of about ``chars`` characters together."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield range(first, i + 1)
            first, total = i + 1, 0
    if first < len(texts):
        yield range(first, len(texts))
