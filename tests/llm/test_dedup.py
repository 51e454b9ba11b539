"""Suffix-array dedup, SimHash, chained passages and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quire.llm import common
from quire.llm.lines import without_boilerplate
from quire.llm.parts import LAST
from quire.llm.passages import aligned, aligned_gap, chains, grouped_segments, holders, most_agreeing, repeated_passages, segments, stretches, unholders, word_hashes
from quire.llm.simhash import _linked, fingerprint, simhash_dedup, simhash_groups
from quire.llm.suffixes import removed_substrings

from .conftest import COLUMNS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def removed(rows, depth=50):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - depth + 1):
            first[b[p:p + depth]] = min(first.get(b[p:p + depth], LAST), LAST if i is None else i)
    out = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if first[b[p:p + depth]] < (LAST if i is None else i):
                gone[p:p + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_dedup_matches_brute_force(odd, rows, monkeypatch, parts):
    monkeypatch.setattr("quire.llm.suffixes.text_parts", lambda *a, **k: parts)
    got = removed_substrings(odd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows)
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(n for _, n in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_suffix_dedup_of_overlaps_and_edges(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.suffixes.text_parts", lambda *a, **k: 3)
    r = random.Random(3)
    pool = ["".join(r.choices("ab\0 ", k=n)) for n in (49, 50, 51, 68, 69, 120)] + ["ab" * 60, "a" * 49, "a" * 50, "é" * 30]
    rows = [(k, "".join(r.choice(pool) + r.choice(["", "x", "yz", "\0"]) for _ in range(r.randint(1, 5)))) for k in range(60)]
    got = removed_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == removed(rows)


def test_suffix_dedup_of_nothing(none):
    assert removed_substrings(none).collect() == []


def plain_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(n, pairs):
    """The smallest member of each member's component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def roots(fps, bits=2):
    return joined(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= bits])


def test_simhash_matches_brute_force(odd, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain_fingerprint(t) for _, t, *_ in order]
    want = Counter((r[0], f, order[k][0]) for r, f, k in zip(order, fps, roots(fps)))
    got = simhash_groups(odd).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash_dedup(odd).collect()
    assert Counter(r.doc_id for r in kept) == Counter(order[k][0] for k in set(roots(fps)))
    assert len({plain_fingerprint(r.text) for r in kept}) == len(kept) and set(COLUMNS) < set(kept[0].asDict())


def test_links_join_exactly_the_near_pairs():
    r = random.Random(1)
    for n, spread in ((5, 16), (64, 10), (65, 10), (300, 9), (400, 16)):
        fps = np.array(sorted({r.getrandbits(spread) | 0xABCD << 48 for _ in range(n)}), np.uint64)
        n = len(fps)
        at = {int(x): k for k, x in enumerate(fps)}
        links = [(int(a), int(b)) for a, b in _linked(fps, 2)]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        assert joined(n, [(at[a], at[b]) for a, b in links]) == roots([int(x) for x in fps])


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (1002, 1001)], "a long, b long").repartition(6)
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_simhash_of_nothing(none):
    assert simhash_groups(none).collect() == [] and simhash_dedup(none).collect() == []


def test_fingerprint_of_few_words():
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("parts", [1, 5])
def test_planted_passages_are_found(spark, monkeypatch, parts):
    monkeypatch.setattr("quire.llm.passages.text_parts", lambda *a, **k: parts)
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(3, 7)))
    passage = [word() for _ in range(70)]
    rows, edits = [], {3: [], 8: [11, 40], 9: [5, 25, 45, 60], 12: [33]}
    for k in range(15):
        body = [word() for _ in range(150)]
        if k in edits:
            own = list(passage)
            for e in edits[k]:
                own[e] = word()
            body[60:60] = own
        rows.append((k, " ".join(body).upper() if k == 8 else " \n".join(body)))
    rows += [(20, rows[1][1]), (21, rows[1][1]), (None, rows[2][1]), (22, None), (23, "")]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id for x in got} == {8, 9, 12, 20, 21, None}
    for x in got:
        if x.doc_id in edits:
            assert x.source_doc_id == 3 and 55 <= x.start <= 65 and 60 <= x.length <= 76 and x.similarity >= 0.8 and x.matches >= x.similarity * x.length - 1
        else:
            assert (x.start, x.length, x.similarity) == (0, 150, 1.0)


def test_passages_of_odd_rows(odd, rows):
    got = repeated_passages(odd).collect()
    texts = {i: WORD.findall((t or "").lower()) for i, t, *_ in rows if i not in (None, 16, 17)}
    assert {6, 8, 9, 10} <= {r.doc_id for r in got}
    for r in got:
        assert r.length >= 40 and r.similarity >= 0.8
        if r.doc_id in texts:
            assert r.source_doc_id < r.doc_id
            a, b = texts[r.doc_id][r.start:r.start + r.length], texts[r.source_doc_id][r.source_start:r.source_start + r.source_length]
            assert len(a) == r.length and len(b) == r.source_length
            assert sum(x and y for x, y in zip([True] * len(a), [w in set(b) for w in a])) >= 0.8 * len(a)


def test_passages_of_nothing(none):
    assert repeated_passages(none).collect() == []


def test_word_hashes_follow_words():
    texts = ["a B  c\n", "", "A b\tC", " x", "x"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    h, of = word_hashes(np.frombuffer(b"".join(raw), np.uint8), at)
    assert of.tolist() == [0, 3, 3, 6, 7, 8]
    assert (h[:3] == h[3:6]).all() and h[6] == h[7] and len(set(h[:3].tolist())) == 3


def best_chain(segs, cost=0.05, over=4, gap=64):
    """The quadratic rule that the tree stands for."""
    score = []
    for i, (x, y, n) in enumerate(segs):
        near = [score[j] - cost * (x - a - m + y - b - m) for j, (a, b, m) in enumerate(segs[:i]) if a + m - over <= x and b + m - over <= y]
        score.append(n + max([0.0, *near]))
    return max(score)


def test_fenwick_chains_match_the_quadratic_rule():
    r = random.Random(2)
    for _ in range(200):
        segs = sorted({(r.randint(0, 60), r.randint(0, 60), r.randint(5, 12)) for _ in range(r.randint(2, 14))}, key=lambda s: (s[1], s[0]))
        found = chains(segs)
        assert sorted(s for c in found for s in c) == sorted(segs)
        for c in found:
            assert all(a[0] + a[2] - 4 <= b[0] and a[1] + a[2] - 4 <= b[1] for a, b in zip(c, c[1:]))
        first = found[0]
        total = sum(s[2] for s in first) - 0.05 * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(first, first[1:]))
        assert total == pytest.approx(best_chain(segs))


def test_chains_pass_over_what_is_too_far():
    """A long run far before a passage is no reason to leave the passage's halves apart."""
    assert chains([(0, 0, 300), (400, 400, 30), (430, 431, 30)]) == [[(0, 0, 300)], [(400, 400, 30), (430, 431, 30)]]
    r = random.Random(4)
    for _ in range(300):
        wide = r.choice([100, 300, 900])
        segs = sorted({(r.randint(0, wide), r.randint(0, wide), r.randint(5, 40)) for _ in range(r.randint(2, 30))}, key=lambda s: (s[1], s[0]))
        score = []
        for i, (x, y, n) in enumerate(segs):
            near = [score[j] - 0.05 * (x - a - m + y - b - m) for j, (a, b, m) in enumerate(segs[:i]) if 0 <= x - a - m + 4 <= 68 and 0 <= y - b - m + 4 <= 68]
            score.append(n + max([0.0, *near]))
        found = chains(segs)
        assert sorted(s for c in found for s in c) == sorted(segs)
        assert all(max(b[0] - a[0] - a[2], b[1] - a[1] - a[2]) <= 64 for c in found for a, b in zip(c, c[1:]))
        first = found[0]
        total = sum(s[2] for s in first) - 0.05 * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(first, first[1:]))
        assert total == pytest.approx(max(score))


def test_segments_and_alignment_helpers():
    assert segments(np.array([0, 3, 40, 7]), np.array([10, 13, 50, 90])) == [(0, 10, 8), (40, 50, 5), (7, 90, 5)]
    assert sum(s[2] for s in aligned_gap([1, 2, 3], [1, 9, 3, 4])) == 2
    same = np.array([False] * 10 + [True] * 50 + [False] * 30 + [True] * 45)
    assert sorted(stretches(same, 0.8, 40)) == [(10, 59), (90, 134)]


def test_groups_have_the_segments_of_each():
    rng = np.random.default_rng(5)
    group, x, y = np.sort(rng.integers(0, 9, 400)), rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    g, *found = grouped_segments(group, x, y)
    for k in range(9):
        assert list(zip(*(c[g == k].tolist() for c in found))) == segments(x[group == k], y[group == k])
    assert segments(x[:0], y[:0]) == []


def test_chains_left_out_hold_no_passage():
    """The bound of all chains at once is no less than what their alignments agree on, and theirs where there is no gap."""
    rng = np.random.default_rng(9)
    own, source = rng.integers(0, 3, 700).astype(np.uint32), rng.integers(0, 3, 900).astype(np.uint32)
    rows, made = [], []
    for at, size, other, length in ((0, 300, 0, 200), (300, 400, 200, 700)):
        for chain in [c for _ in range(60) for c in chains(segments(rng.integers(0, length - 4, 6), rng.integers(0, size - 4, 6)))]:
            rows += [(len(made), *s, at, size, other, length) for s in chain]
            made.append((len(chain), aligned(chain, own[at:at + size], source[other:other + length])[2].sum()))
    chain, x, y, n, *texts = np.array(rows).T
    most = most_agreeing(chain, x, y, n, own, *texts[:2], source, *texts[2:])
    assert max(k for k, _ in made) > 1
    assert all(m == agree if k == 1 else m >= agree for m, (k, agree) in zip(most.tolist(), made))


def test_holders_travel_in_the_order_of_documents():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 3000).astype(np.uint64))
    ids, where = rng.integers(-5, 10**9, len(keys)), rng.integers(0, 1 << 42, len(keys))
    ids[::7] = LAST
    back = unholders(holders(keys, ids, where), len(keys))
    assert sorted(zip(*(c.tolist() for c in back))) == list(zip(keys.tolist(), ids.tolist(), where.tolist()))
    few = np.sort(rng.integers(0, 900, len(keys))) * 1000
    assert len(holders(keys, rng.permutation(few), where % 500)) < 8.5 * len(keys)


def test_every_stretch_that_qualifies_is_found():
    r = random.Random(6)
    for _ in range(400):
        n, p = r.randint(1, 90), r.choice([0.6, 0.75, 0.8, 0.85, 0.95])
        same = np.array([r.random() < p for _ in range(n)])
        sums = np.concatenate([[0], np.cumsum(same)])
        good = [(a, b) for a in range(n) for b in range(a + 39, n) if same[a] and same[b] and 5 * (sums[b + 1] - sums[a]) >= 4 * (b + 1 - a)]
        found = stretches(same, 0.8, 40)
        assert set(found) <= set(good)
        assert all(any(a <= d and c <= b for c, d in found) for a, b in good)


@pytest.mark.parametrize("n, edits", [
    (50, range(10, 46, 5)),  # 0.84, evenly spread
    (100, range(12, 93, 5)),  # 0.83
    (60, range(39, 44)),  # under 40 equal words on either side of the edits
    (40, range(8, 39, 4)),  # 0.8
    (45, range(8, 41, 4)),  # 0.8
    (42, range(9, 40, 6)),  # 0.857
])
def test_passages_at_the_threshold_are_found(spark, n, edits):
    r = random.Random(n)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(4, 8)))
    text = lambda passage: " ".join([*(word() for _ in range(70)), *passage, *(word() for _ in range(70))])
    passage = [word() for _ in range(n)]
    edited = [word() if k in edits else w for k, w in enumerate(passage)]
    got = repeated_passages(spark.createDataFrame([(1, text(passage)), (2, text(edited))], "doc_id long, text string")).collect()
    assert {x for g in got for x in range(g.start, g.start + g.length)} == set(range(70, 70 + n))
    assert all(x.doc_id == 2 and x.source_doc_id == 1 and x.start == x.source_start and x.length >= 40 and x.similarity >= 0.8 for x in got)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("pieces, held", [
    ([30, 30], [(0,), (1,)]),
    ([15] * 4, [(0,), (1,), (2,), (3,), (0, 1), (1, 2), (2, 3)]),
    ([13, 13, 14], [(0, 1), (1, 2)]),
    ([10] * 6, [(0, 1, 2), (1, 2, 3), (2, 3, 4), (3, 4, 5)]),
    ([100, 100], [(0,), (1,)]),
])
def test_passages_of_pieces_that_stand_alone_before(spark, monkeypatch, parts, pieces, held):
    """The pieces of a passage each have a first holder of their own, the whole only a later one."""
    monkeypatch.setattr("quire.llm.passages.text_parts", lambda *a, **k: parts)
    r = random.Random(len(pieces))
    some = lambda n: ["".join(r.choices("abcdefghijklmnop", k=r.randint(4, 8))) for _ in range(n)]
    lines = [some(n) for n in pieces]
    text = lambda which: " ".join([*some(50), *(w for k in which for w in lines[k]), *some(50)])
    whole = range(len(pieces))
    rows = [(k, text(which)) for k, which in enumerate(held)] + [(20, text(whole)), (21, text(whole))]
    got = [x for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.doc_id == 21]
    assert {x for g in got for x in range(g.start, g.start + g.length)} == set(range(50, 50 + sum(pieces)))
    assert 20 in {x.source_doc_id for x in got}


def test_line_dedup_matches_brute_force(odd, rows):
    where, first = defaultdict(set), {}
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            where[line.strip(" \t\n\r\x0b\x0c")].add(s)
    for i, t in order:
        for p, line in enumerate((t or "").split("\n")):
            first.setdefault(line.strip(" \t\n\r\x0b\x0c"), (i, t, p))
    want = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n") if t is not None else []
        kept = [x for p, x in enumerate(lines) if not (k := x.strip(" \t\n\r\x0b\x0c")) or len(where[k]) < 10 or first[k] == (i, t, p)]
        want[i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = without_boilerplate(odd).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == want
    assert sum(r.n_removed for r in got) == 29


@pytest.mark.parametrize("n", [8, 9, 10, 11, 12, 300])
def test_threshold_is_exact(spark, n):
    docs = spark.createDataFrame([(k, f"own {k}\nspread", f"s{k % n}") for k in range(2 * n)], "doc_id long, text string, source string").repartition(4)
    removed = sum(r.n_removed for r in without_boilerplate(docs).collect())
    assert removed == (2 * n - 1 if n >= 10 else 0)


def test_line_dedup_of_nothing(none):
    assert without_boilerplate(none).collect() == []


def test_prose_is_repeatable():
    assert prose(1, 5) == prose(1, 5)
