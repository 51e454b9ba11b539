"""Decontamination, the Merkle manifest and fill-in-the-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontamination as d
from quire.llm import fim
from quire.llm import manifest as m
from quire.llm.queries import QUERIES

NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return NORMAL.findall((text or "").translate(LOWER))


def plain_contamination(docs, items):
    """Every window against every position; per document its words, hit word numbers and items."""
    windows = {(i, tuple(w[k:k + 10])) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - 9)) if w}
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    own.add("" if item is None else str(item))
        yield i, t or "", len(w), hit, sorted(own)


@pytest.fixture(scope="module")
def items(rows):
    base = words(rows[7][1])
    return [(1, " ".join(base[5:30])), (2, "ONE two, three"), (10, "one"), (3, None), (4, ""), (5, " .,; "), (None, "日本語 日本語"), (6, "la " * 12), (6, "shared boilerplate line"),
            (7, "Ça va? Ça ne va PAS du tout, 3,5 fois"), (8, " ".join(base[5:30])), (9, "noise line of"), (11, "a" * 5000)]


@pytest.mark.parametrize("limits", [{}, {"max_pairs": 5}, {"max_bytes": 300}])
def test_decontamination_matches_brute_force(spark, odd, rows, items, limits):
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("x"))
    docs = [(i, t) for i, t, *_ in rows if t is None or len(t) < 20_000] + [(300, "x Ça va,Ça\nne va pas (du tout) 3.5 FOIS: Ça va ça ne"), (301, "one\x00two\x7fthree"), (302, "onetwo three")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("n_hit", F.lit(1)).repartition(4)
    got = d.contaminated(df, table, **limits).collect()
    want = list(plain_contamination(docs, items))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter((i, n, len(hit), tuple(own)) for i, _, n, hit, own in want)
    texts = defaultdict(list)
    for i, t, _, hit, _ in want:
        texts[i].append((t, hit))
    for r in got:  # the spans are the runs of hit words in the original
        t, hit = texts[r.doc_id][0]
        if len(texts[r.doc_id]) == 1:
            runs = [k for k in sorted(hit) if k - 1 not in hit]
            assert len(r.spans) == len(runs) and sum(len(words(t[s.start:s.end])) for s in r.spans) == len(hit)
            places = [x.span() for x in NORMAL.finditer(t.translate(LOWER))]
            assert [s.start for s in r.spans] == [places[k][0] for k in runs]
    assert any(r.n_hit for r in got if r.doc_id == 300) and not any(r.n_hit for r in got if r.doc_id == 302)


def test_decontamination_of_questions_and_answers(spark):
    items = spark.createDataFrame([("q1", "What is it?", "It is the old stone bridge")], "item_id string, question string, answer string")
    docs = spark.createDataFrame([(1, "so what is it? it's gone"), (2, "it is the OLD stone-bridge"), (3, "is it the old stone bridge")], "doc_id long, text string")
    got = {r.doc_id: r for r in d.contaminated(docs, items, texts=("question", "answer")).collect()}
    assert [(got[k].n_hit, [tuple(s) for s in got[k].spans]) for k in (1, 2, 3)] == [(3, [(3, 13)]), (6, [(0, 26)]), (0, [])]


def test_decontamination_of_nothing(spark, odd, none, rows):
    items = spark.createDataFrame([], "item_id long, text string")
    got = d.contaminated(odd, items).collect()
    assert len(got) == len(rows) and all(r.n_hit == 0 and r["items"] == [] and r.spans == [] for r in got)
    assert d.contaminated(none, spark.createDataFrame([(1, "one")], "item_id long, text string")).collect() == []


def test_words_are_spelled_apart():
    """Words of many items need several letters; a match never begins inside a word."""
    r = random.Random(4)
    pool = [f"w{k}" for k in range(5000)]
    text = [r.choice(pool) for _ in range(4000)]
    a = d.Automaton([(w, "1") for w in d.windows_of([x.encode() for x in pool])] + [(" ".join(text[50:53]).encode(), "2")])
    hit, own = a.scan([x.encode() for x in text])
    want = {k + j for k in range(len(text) - 2) if text[k:k + 3] == text[50:53] for j in range(3)}
    assert a.places == 4 and set(hit.tolist()) >= want and "2" in own


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """The root, and for each leaf its levels of (siblings before, siblings after)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a // 3 * 3:a // 3 * 3 + 3]
            paths[k].append((run[:a % 3], run[a % 3 + 1:]))
            at[k] = a // 3
        level = [sha(*level[k:k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    trees = defaultdict(list)
    for i, text, lang, source, n_chars, *_ in rows:
        gone = i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0
        trees[source].append((i is not None, i or 0, leaf_of((i, source, lang, n_chars, text)), i, leaf_of((i, source, lang, n_chars, text.replace("\n", "") if gone else text))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: plain_tree([x[2] for x in sorted(trees[s])]) for s in order}
    root, tops = plain_tree([subs[s][0] for s in order])
    for s, top in zip(order, tops):
        for x, path in zip(sorted(trees[s]), subs[s][1]):
            folded = x[4]
            for before, after in path + top:
                folded = sha(*before, folded, *after)
            yield x[3], x[2], subs[s][0], root, sha(*(y for before, after in path + top for y in before + after)), folded, folded == root


@pytest.fixture(params=[7, 1, 2])
def levels(request, monkeypatch):
    """Blocks of 2187, of three and of nine leaves: small ones make many rounds of appends."""
    monkeypatch.setattr(m, "LEVELS", request.param)
    monkeypatch.setattr(m, "BLOCK", 3 ** request.param)


def test_manifest_matches_brute_force(odd, rows, levels):
    got = m.tampering_found(odd).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))
    assert len({r.root for r in got}) == 1 and any(not r.verified for r in got) and any(r.verified for r in got)


def test_manifest_of_one_large_source(spark, levels):
    rows = [(k, f"text {k}\n", "en", "hot" if k % 3 else f"s{k % 5}", k) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    assert Counter(map(tuple, m.tampering_found(df).collect())) == Counter(plain_manifest(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_manifest_of_one_source(spark, n):
    rows = [(k, None, None, None, None) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, m.tampering_found(df).collect())) == Counter(plain_manifest(rows))


def test_manifest_of_nothing(none):
    assert m.tampering_found(none).collect() == []


def test_witnesses_are_extended_as_runs_close():
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(20)]
    a = m.Appender()
    for k, x in enumerate(leaves):
        a.append(x)
        if k == 2:  # one complete run: a step of one level for its leaves
            assert [len(w) for w in a.witnesses] == [65] * 3
        if k == 8:
            assert [len(w) for w in a.witnesses] == [130] * 9
    root = a.close(m.levels_of(20))
    assert root.hex() == plain_tree([x.hex() for x in leaves])[0]
    assert all(m.folded(x, bytes(w)) == root for x, w in zip(leaves, a.witnesses)) and m.folded(leaves[1], bytes(a.witnesses[0])) != root


def plain_fim(doc_id, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, mid, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{mid}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{mid}"
    return doc_id, n, "spm" if h4 % 100 < 50 else "psm", len(p), len(mid), out


def test_fim_matches_brute_force(spark, odd, rows):
    docs = [(i, t) for i, t, *_ in rows] + [(400, "a <P> b\n"), (401, "<M>"), (402, "\n\n\n"), (403, "x\r\ny\x85z z\x0b\n<S\n>"), (404, "<"), (405, "<S"), (406, "S>\nP>\nM>\n<\n<M")]
    df = odd.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*x, "c") for x in docs[len(rows):]], "doc_id long, text string, n string"))
    got = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(plain_fim(i, t or "") for i, t in docs)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in docs)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_of_other_rates_and_markers(spark):
    df = spark.createDataFrame([(k, f"a{k}\nb\nc") for k in range(200)], "doc_id long, text string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    got = fim.fill_in_middle(df, seed=1, markers=marks, fim_percent=30, spm_percent=100).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == f"a{r.doc_id}\nb\nc" for r in got) and 30 < sum(r.form == "spm" for r in got) < 90 and not any(r.form == "psm" for r in got)


def test_fim_of_nothing(none):
    assert fim.fill_in_middle(none).collect() == []


def test_skip_list_reaches_every_rank():
    r = np.random.default_rng(5)
    for n in [*range(1, 40), 1000, 5000]:
        widths = r.integers(1, 30, n)
        at = np.concatenate([[0], np.cumsum(widths)])
        s = fim.SkipList(widths)
        assert [s.place(k) for k in range(n + 1)] == at.tolist()
    assert len(s.lanes) > 4 and all((u.sum() <= n and c.sum() <= at[-1]) for u, c in s.lanes)


def test_queries_carry_the_columns_of_their_contracts(spark):
    sf = "/root/testdata/sf0.001"
    assert QUERIES["op11_decontamination"](spark, sf).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert QUERIES["op12_manifest"](spark, sf).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert QUERIES["op13_fill_in_middle"](spark, sf).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
