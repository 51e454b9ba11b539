"""Document fingerprints by one-permutation MinHash with optimal densification; DataFrame functions only.

The hashes of a text's five-word shingles are sorted once; the top bits of a hash name one of ``BINS`` bins, and the
first hash of each bin in that order is the bin's minimum. An empty bin i
copies from the first filled bin in an order of all bins that is drawn for i (start and odd stride from a seeded
rule), so that texts which fill the same bins choose the same donors and donors are independent between bins. Early
places in that order are looked up in rounds over the whole array; what then is still empty takes the filled bin
whose place in the order is the least, which is the same bin the rounds would reach.

Of the minimum, hashed with its bin, the ``BITS`` low-order bits are kept, so that bins with one donor don't agree by
one chance. Two unrelated bins agree in ``BITS`` bits with chance ``2 ** -BITS``; with p the share of agreeing bins the likeness
is ``(p - c) / (1 - c)``, at least 0. Bins are packed eight to a long.

Nulls and corner cases: a null text is an empty one; a text of one to four words is one shingle; texts without words
have a fingerprint of zeros, likeness 1 among themselves and 0 to all others. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, apart, let, saved

BINS, BITS, WORDS = 256, 8, 5
SEED = 42
#: Places of an empty bin's order that are looked up in rounds.
ROUNDS = 8
#: Documents to a window of the search for the next document.
WINDOW_ROWS = 4096
M64, M48 = (1 << 64) - 1, (1 << 48) - 1


def _mixed(x: int) -> int:
    """The finalizer of splitmix64."""
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def donor_orders(seed: int = SEED) -> tuple[list[int], list[int]]:
    """For each bin the start and the odd stride of its order of bins."""
    drawn = [_mixed(seed * BINS + i) for i in range(BINS)]
    return [x % BINS for x in drawn], [(x >> 32) % BINS | 1 for x in drawn]


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles; of fewer words, one hash of all."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    pair = lambda a, b: F.xxhash64(a, b)

    def of(w: Column) -> Column:
        n = F.size(w)
        two = F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), pair)
        four = let(two, lambda t: F.zip_with(F.slice(t, F.lit(1), n - 3), F.slice(t, F.lit(3), n - 3), pair))
        five = let(four, lambda t: F.zip_with(F.slice(t, F.lit(1), n - 4), F.slice(w, F.lit(5), n - 4), pair))
        return F.when(n >= WORDS, five).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 56) + BINS // 2


def fingerprint(text: Column, seed: int = SEED) -> Column:
    """The packed fingerprint, 32 longs; empty for a text without words."""
    start, stride = donor_orders(seed)
    inverse = [pow(b, -1, BINS) for b in stride]

    def filled(h: Column) -> Column:
        """Of sorted hashes, the first of each bin: the bin above 48 bits of the hash."""
        before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))
        first = F.zip_with(h, before, lambda x, y: F.when(y.isNull() | (F.shiftright(x, 56) != F.shiftright(y, 56)), F.shiftleft(_bin(x), 48).bitwiseOR(x.bitwiseAND(M48))))
        return F.filter(first, lambda x: x.isNotNull())

    def dense(s: Column) -> Column:
        """All bins in order, the empty ones null."""
        at = lambda x: F.shiftright(x, 48).cast("int")
        before = F.concat(F.array(F.lit(-1)), F.transform(F.slice(s, F.lit(1), F.size(s) - 1), at))
        gap = F.zip_with(s, before, lambda x, b: F.concat(F.array_repeat(F.lit(None).cast("bigint"), at(x) - b - 1), F.array(x.bitwiseAND(M48))))
        return F.concat(F.flatten(gap), F.array_repeat(F.lit(None).cast("bigint"), F.lit(BINS - 1) - at(F.element_at(s, -1))))

    def donated(s: Column) -> Column:
        def rounds(own: Column) -> Column:
            x = own
            for t in range(ROUNDS):
                x = F.zip_with(x, F.lit([(a + t * b) % BINS for a, b in zip(start, stride)]), lambda v, j: F.coalesce(v, F.get(own, j)))
            return x

        def place(x: Column, a: Column, b: Column) -> Column:
            first = ((F.shiftright(x, 48) - a + BINS) * b).bitwiseAND(BINS - 1)
            return F.shiftleft(first, 48).bitwiseOR(x.bitwiseAND(M48))

        def rest(x: Column) -> Column:
            orders = F.lit([a * BINS + b for a, b in zip(start, inverse)])
            return F.zip_with(x, orders, lambda v, o: F.coalesce(v, F.array_min(F.transform(s, lambda y: place(y, F.shiftright(o, 8), o.bitwiseAND(255)))).bitwiseAND(M48)))

        return F.when(F.size(s) == BINS, dense(s)).otherwise(rest(let(dense(s), rounds)))

    def packed(x: Column) -> Column:
        def long(g: Column) -> Column:
            out = F.shiftleft(F.get(x, g * 8), 56)
            for k in range(1, 8):
                out = out.bitwiseOR(F.shiftleft(F.get(x, g * 8 + k), 56 - 8 * k))
            return out
        return F.transform(F.lit(list(range(BINS // 8))), long)

    def kept(x: Column) -> Column:
        return F.transform(x, lambda v, i: F.xxhash64(v, i).bitwiseAND(255))

    empty = F.array().cast("array<bigint>")
    first = let(F.sort_array(shingle_hashes(text)), filled)
    return let(first, lambda s: F.when(F.size(s) == 0, empty).otherwise(let(kept(donated(s)), packed)))


def as_hex(fp: Column) -> Column:
    digits = F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return F.when(F.size(fp) == 0, F.lit("0" * (BINS * BITS // 4))).otherwise(digits)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingles of two fingerprints, corrected for chance agreement."""
    def equal_bytes(x: Column) -> Column:  # zero bytes of four
        carried = (x.bitwiseAND(0x7F7F7F7F) + 0x7F7F7F7F).bitwiseOR(x).bitwiseAND(0x80808080)
        return F.lit(4) - F.bit_count(carried)

    both = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    equal = F.aggregate(both, F.lit(0), lambda n, x: n + equal_bytes(x.bitwiseAND(0xFFFFFFFF)) + equal_bytes(F.shiftrightunsigned(x, 32)))
    c = 2.0 ** -BITS
    share = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - c) / (1 - c))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), share).otherwise((F.size(a) == F.size(b)).cast("double"))


def fingerprints(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint`` (hex) of every whole text."""
    fp = apart(docs.select("doc_id", "text"), fp=fingerprint(F.col("text"), seed))
    return fp.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"))


def with_next(docs: DataFrame, cols: list[str], ids: DataFrame | None = None) -> DataFrame:
    """Add ``_next``, a struct of the ``cols`` of the next document by descending doc_id (of the first, after the
    last; null ids come last, equal ids by text).

    Documents are windowed within ranges of ids, each range with the first document of the following one as a guest;
    ranges are as wide as ``WINDOW_ROWS`` documents on average. The guests are one row for each range and are saved
    first, so that Spark knows their size and broadcasts them only if they are small. ``ids`` has the doc_ids of
    ``docs`` where these are cheaper to read by themselves.
    """
    ids = ids if ids is not None else docs
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, -(-n // WINDOW_ROWS))))
    key = F.coalesce(F.col("doc_id"), F.lit((low or 0) - 1))
    span = F.floor((key - (low or 0)) / width).cast("long")
    order = Window.orderBy(F.col("_span").desc())
    tops = ids.select(key.alias("_key"), span.alias("_span")).groupBy("_span").agg(F.max("_key").alias("_key"))
    tops = tops.select("_key", F.coalesce(F.lag("_span").over(order), F.min("_span").over(Window.partitionBy())).alias("_host"))
    docs = docs.withColumns({"_key": key, "_span": span}).join(saved(tops, "tops"), "_key", "left")
    places = F.array(F.struct(F.lit(0).alias("guest"), F.col("_span").alias("span")), F.struct(F.lit(1).alias("guest"), F.col("_host").alias("span")))
    docs = docs.withColumn("_place", F.explode(F.filter(places, lambda p: p["span"].isNotNull()))).drop("_span", "_host")
    docs = docs.withColumns({"_guest": F.col("_place.guest"), "_span": F.col("_place.span")}).drop("_place")
    order = Window.partitionBy("_span").orderBy("_guest", F.col("_key").desc(), "text")
    docs = docs.withColumn("_next", F.lead(F.struct(*cols)).over(order))
    return docs.where("_guest = 0").drop("_guest", "_span", "_key")


def near_edited(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the beginning of the next document,
    with the likeness of the text's fingerprint to that of the edited text and of the next document."""
    x = apart(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), fp=fingerprint(F.col("text"), seed))
    x = with_next(x, ["text", "fp"], docs.select("doc_id"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("_next.text"), F.lit(1), third))
    x = x.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("_next.fp").alias("next_fp"), edited.alias("edited"))
    x = apart(x, edited_fp=fingerprint(F.col("edited"), seed))
    return x.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
