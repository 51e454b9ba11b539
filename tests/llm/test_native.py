"""Licence scans, fingerprints and mixing."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import fingerprints as fp
from quire.llm.licenses import TEMPLATES, bigrams, license_scan, size_bounds
from quire.llm.mixing import _first_words, mixed_documents, mixing_plan, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def units(text):
    out = [text]
    lines = text.split("\n")
    out += lines if len(lines) > 1 else []
    blocks = re.split(r"\n(?:[\x20\x09\x0B-\x0D]*\n)+", text)
    return out + (blocks if len(blocks) > 1 else [])


def test_licenses_match_brute_force(odd, rows):
    want = defaultdict(list)
    for i, text, *_ in rows:
        for u in units(text) if text is not None else []:
            a = set(bigrams(u))
            for no, (name, t) in enumerate(TEMPLATES):
                b = set(bigrams(t))
                if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                    want[i, name].append((2 * len(a & b) / (len(a) + len(b)), no))
    got = {(r.doc_id, r.license): r for r in license_scan(odd).collect()}
    assert set(got) == set(want) and {(19, "MIT"), (20, "Apache-2.0"), (20, "Proprietary")} <= set(got)
    for k, r in got.items():
        assert r.dice == pytest.approx(max(want[k])[0])


def test_size_bounds_are_exact():
    for n in range(1, 60):
        lo, hi = size_bounds(n, 0.8)
        reach = [a for a in range(1, 200) if 2 * min(a, n) / (a + n) >= 0.8 - 1e-12]
        assert (lo, hi) == (min(reach), max(reach))


def test_license_scan_of_nothing(none):
    assert license_scan(none).collect() == []


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_estimate_likeness(odd, rows):
    got = fp.near_edited(odd).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (-(r[0] if r[0] is not None else -1), r[1].encode()))
    want = Counter()
    off = []
    by = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[:len(t) - m] + nxt[:m]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        by[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] = shingles(t), shingles(edited), shingles(nxt)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    for r in got:
        a, b, c = by[r.doc_id, r.n_chars, r.edited_sha256]
        for x, near in ((b, r.near_edited), (c, r.near_next)):
            true = len(a & x) / len(a | x) if a | x else 1.0
            off.append(abs(near - true))
            assert 0 <= near <= 1 and off[-1] < 0.16
        assert len(r.fingerprint) == len(r.edited_fingerprint) == fp.BINS * fp.BITS // 4
    assert sum(off) / len(off) < 0.03


def test_equal_texts_have_equal_fingerprints(odd, rows):
    got = defaultdict(set)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for r in fp.fingerprints(odd).collect():
        if len(set(texts[r.doc_id])) == 1:
            got[texts[r.doc_id][0] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in got.values())
    assert got[""] == {"0" * (fp.BINS * fp.BITS // 4)}


def test_densification_matches_the_plain_rule(spark):
    """Places looked up in rounds and the least place reach the same donor as walking the order bin by bin."""
    text = "a b c d e f g h i j k"
    packed = spark.createDataFrame([(text,)], "text string").select(fp.fingerprint(F.col("text")).alias("x"), F.sort_array(fp.shingle_hashes(F.col("text"))).alias("h")).first()
    own = {}
    for h in packed.h:
        own.setdefault((h >> 56) + 128, h & (1 << 48) - 1)
    start, stride = fp.donor_orders()
    want = []
    for i in range(fp.BINS):
        walk = [i] if i in own else [(start[i] + t * stride[i]) % fp.BINS for t in range(fp.BINS)]
        want.append(next(own[j] for j in walk if j in own))
    pairs = spark.createDataFrame([(i, v) for i, v in enumerate(want)], "i int, v long").orderBy("i")
    want = [r[0] % 256 for r in pairs.select(F.xxhash64("v", "i")).collect()]
    got = b"".join((x % (1 << 64)).to_bytes(8, "big") for x in packed.x)
    assert list(got) == want


def test_fingerprints_of_nothing(none):
    assert fp.near_edited(none).collect() == []


@pytest.mark.parametrize("width", [1, 3, 7])
def test_next_document_over_many_windows(spark, monkeypatch, width):
    monkeypatch.setattr(fp, "WINDOW_ROWS", width)
    ids = [3, 900, 4, 17, 5, -8, 1_000_000]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.t for r in fp.with_next(docs, ["text"]).select("doc_id", F.col("_next.text").alias("t")).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def water_filled(sizes, weights):
    """The rule step by step: clamp, reshare by weight, until none is above."""
    total, clamped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[k] for k in clamped)
        share = sum(w for k, w in enumerate(weights) if k not in clamped)
        target = [3.0 * sizes[k] if k in clamped else rest * weights[k] / share for k in range(len(sizes))]
        above = {k for k in range(len(sizes)) if k not in clamped and target[k] > 3 * sizes[k]}
        if not above:
            return target
        clamped |= above


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100, 1], [0, 5, 5], [100], [1, 1, 1, 1000], [7, 0, 0, 0, 3], [1, 2, 3, 4, 500, 6, 7, 8]])
def test_targets_match_stepwise_water_filling(spark, sizes):
    df = spark.createDataFrame([(f"s{k:02d}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in source_targets(df).orderBy("source").collect()]
    assert got == pytest.approx(water_filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))]))


def test_mixing_takes_its_targets(odd, rows):
    got = mixing_plan(odd).collect()
    assert sorted(mixing_plan(odd.repartition(2)).collect(), key=str) == sorted(got, key=str)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = water_filled([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    for s, target in zip(names, targets):
        mine = [r for r in got if r.source_size == sizes[s] and r.target == pytest.approx(target)]
        assert mine and all(0 <= r.taken <= 3 * r["size"] for r in mine)
    assert abs(sum(r.taken for r in got) - sum(targets)) <= len(names)


def test_mixed_documents_hold_the_words_taken(odd):
    taken, held = Counter(), Counter()
    for r in mixing_plan(odd).collect():
        taken[r.doc_id] += r.taken
    mixed = mixed_documents(odd)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for r in mixed.collect():
        held[r.doc_id] += len(WORD.findall(r.text))
    assert +taken == +held


def test_first_words_keep_what_stands_between(spark):
    df = spark.createDataFrame([("  a\tb \n c d ", n) for n in range(5)], "t string, n int")
    assert [r[0] for r in df.select(_first_words(F.col("t"), F.col("n"))).collect()] == ["", "  a", "  a\tb", "  a\tb \n c", "  a\tb \n c d"]


def test_mixing_of_nothing(none):
    assert mixing_plan(none).collect() == [] and mixed_documents(none).collect() == []
