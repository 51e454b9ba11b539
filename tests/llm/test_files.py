"""Packing, the WARC archive, quality trees and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import quality as q
from quire.llm.common import scratch_table
from quire.llm.packing import Words, assigned, packed, tokenizer_path
from quire.llm.warc import archived, header_field, read_archive, write_archive

from .conftest import COLUMNS
from .test_dedup import plain_fingerprint, roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    if "it" not in tokens.__dict__:
        tokens.it = Tokenizer.from_file(tokenizer_path())
    return [*tokens.it.encode(text or "", add_special_tokens=False).ids, 1]


def check_sequences(pieces):
    """Every sequence is gapless and needs no padding; gives the pieces of each document."""
    of, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    return of


def test_packing_is_a_round_trip(odd, rows):
    of = check_sequences(got := packed(odd, group_mb=1).collect())
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(tokens(t))
    assert set(of) == set(want)
    for i, pieces in of.items():
        assert sum(r.length for r in pieces) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            ids, at = np.array(want[i][0], "<u4"), 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids == ids[at:at + r.length].tobytes() and r.ids_crc32 == zlib.crc32(r.ids)
                at += r.length
        else:
            assert Counter(r.doc_tokens for r in pieces if r.start == 0) == Counter(map(len, want[i]))
    again = packed(odd.repartition(2), group_mb=1).collect()
    assert Counter(got) == Counter(again)


def test_words_are_tokenized_as_whole_texts(spark):
    odd_texts = ["", " a  b\n", "a b　c", "don't  DON'T's", "é x ́y", "<|endoftext|> x <|startoftext|>a b<|endoftext|>", "a\x0bb\x0cc\x85d", "日本 語。 ok 1234 5a6", "ǅ İ ß ΑΣ Σ", "a�b \U0001f600 ​"]
    docs = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    of = defaultdict(bytes)
    for r in sorted(packed(docs).collect(), key=lambda r: r.start):
        of[r.doc_id] += r.ids
    for i, t in enumerate(odd_texts):
        assert np.frombuffer(of[i], "<u4").tolist() == tokens(t)


def test_words_are_tokenized_as_whole_texts_in_any_order():
    """Fuzzed texts of digits, marks, letters whose lower case is two characters, combining characters and odd spaces; blocks
    one after the other share what the first has learned."""
    r = random.Random(11)
    pool = ["1", "1995", "a_b", "x-1", "]", "]].", "hello", "World", "été", "É", "İ", "ß", "ǅ", "e\u0301", "\u0301", "日本", "don't", "'s", "...", "?!", ".", "1.", "İ!", "<|endoftext|>", "\u1c8a", "ŉ", "ĳ", "9a", "a9.", "\u200d", "🙂"]
    gaps = [" ", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "", "\u200b"]
    marks = ["", "", ".", ",", ";;", "!?", ":"]
    words = Words(tokenizer_path())
    for block in range(40):
        texts = ["".join(r.choice(pool) + r.choice(marks) + r.choice(gaps) for _ in range(r.randint(0, 12))) for _ in range(50)]
        ids, at = words.texts(texts)
        for k, t in enumerate(texts):
            assert ids[at[k]:at[k + 1]].tolist() == tokens(t), repr(t)


@pytest.mark.parametrize("texts", [["1 1."], ["1 1;;"], ["1995 1995,"], ["a_b a_b!"], ["x-1 x-1?"], ["] ]. ."], ["İ!", "İ?", "İ;"], ["hello. world,", "In 1995 it was 1995. ok"]])
def test_words_with_marks(texts):
    words = Words(tokenizer_path())
    for t in texts:  # a block each
        ids, at = words.texts([t])
        assert ids.tolist() == tokens(t)


def test_assignment_balances_cost():
    r = np.random.default_rng(1)
    lengths = sorted(r.integers(1, 900, 400).tolist() + [5000, 2048, 4096], reverse=True)
    room, cost = defaultdict(int), defaultdict(float)
    got = defaultdict(int)
    for k, start, n, s, offset in assigned(lengths):
        assert offset == room[s] and start == got[k]
        room[s] += n
        got[k] += n
        cost[s] += n + n * n / 2048
    assert [got[k] for k in range(len(lengths))] == lengths
    assert all(n == 2048 or n & (n - 1) == 0 for n in room.values())
    shared = [cost[s] for s in room if room[s] == 2048 and cost[s] < 4096]
    assert max(shared) < 1.5 * min(shared)


def test_packing_of_nothing(none):
    assert packed(none).collect() == []


@pytest.fixture(scope="module")
def pages(spark):
    big, small = "<p>" + "x" * 1200 + "é</p>", "<p>small</p>"
    found = [(1, "http://a/1", big), (2, "http://a/2", small), (3, None, big), (4, "http://b/4", None), (5, "http://b/5", ""), (6, "http://b/6", small), (7, "http://c/7", big[:-4]),
             (8, "http://c/8", "y" * 1000), (9, "http://c/9", "y" * 1000), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (None, "n", big), (None, "n", small)]
    return spark.createDataFrame([(*r, "x", None) for r in found], "page_id long, url string, html string, digest string, payload string").repartition(3), found


def test_archive_round_trip(pages):
    df, found = pages
    owner = {}
    for i, _, html in found:
        if i is not None:
            owner[html or ""] = max(owner.get(html or "", i), i)
    got = archived(df).collect()
    want = Counter()
    for i, _, html in found:
        raw = (html or "").encode()
        other = owner.get(html or "")
        revisit = len(raw) >= 1000 and i != other
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", other if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    ids = {}
    for r in got:
        raw = bytes(r.record)
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert raw.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block) - 4
        http, _, body = block[:-4].partition(b"\r\n\r\n")
        assert body == (next((h or "").encode() for i, _, h in found if i == r.page_id and hashlib.sha1((h or "").encode()).hexdigest() == r.payload_digest) if r.record_type == "response" else b"")
        ids[fields["WARC-Record-ID"]] = r
        assert f"Content-Length: {r.payload_bytes}".encode() in http
    for r in got:
        if r.record_type == "revisit":
            named = re.search(rb"WARC-Refers-To: ([^\r]*)", bytes(r.record))[1].decode()
            assert ids[named].page_id == r.refers_to and ids[named].record_type == "response"


def test_archive_stores_a_payload_once_and_finds_damage(spark, pages):
    df, found = pages
    path = scratch_table(spark, "warc-test")
    write_archive(df, path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for *_, h in found}) == stored.select("digest").distinct().count()
    records = spark.read.parquet(f"{path}/records")
    assert records.select(header_field(records.header, "WARC-Type").alias("t")).distinct().count() == 2
    stored.selectExpr("digest", "concat(payload, X'00') AS payload").write.parquet(f"{path}-bad/payloads")
    records.write.parquet(f"{path}-bad/records")
    with pytest.raises(Exception, match="does not match its digest"):
        read_archive(spark, f"{path}-bad").collect()


def test_archive_of_nothing(spark):
    assert archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def plain_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if often[x] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_matches_brute_force(odd, labels, rows):
    got = q.quality(odd, labels).collect()
    want = Counter()
    for i, t, *_ in rows:
        s = plain_statistics(t)
        want[i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]] += 1
    assert Counter((r.doc_id, *(r[c] for c in q.BASE), r.base_failed) for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    kept = q.quality_filter(odd, labels)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_repeated_words_with_many_different_words(monkeypatch):
    words = [str(k).encode() for k in range(3000)] * 2 + [b"a", b"b"]
    assert q.repeated_words(words) == (6000, 3002)


def test_trees_learn_and_keep_their_signs():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2) ^ (r.random(4000) < 0.03)).astype(float)
    trees = q.fitted(x[:3000], y[:3000], [-1, 1, 0])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    for f, sign in ((0, -1), (1, 1)):
        for row in x[:50]:
            line = np.repeat(row[None], 200, axis=0)
            line[:, f] = np.linspace(0, 1, 200)
            assert (sign * np.diff(trees.score(line)) >= -1e-12).all()
    plain = []  # walk the arrays one node at a time
    for row in x[:200]:
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        plain.append(1 / (1 + np.exp(-total)))
    assert trees.score(x[:200]) == pytest.approx(plain)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in q.quality(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [(got[r.doc_id].kept, r.quality) for r in labels.where("doc_id % 2 = 1").collect() if not got[r.doc_id].base_failed]
    assert sum(k == bool(y) for k, y in held) >= 0.95 * len(held)


def test_quality_without_labels_or_rows(odd, none, labels, rows):
    got = q.quality(odd, labels.limit(0)).collect()
    assert len(got) == len(rows) and all(r.kept != r.base_failed for r in got)
    assert q.quality(none, labels).collect() == [] and q.quality_filter(none, labels).collect() == []


def test_pipeline_stages(spark, odd, none, labels, rows, tmp_path):
    sf = f"file://{tmp_path}"
    odd.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pack"]
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = pipeline.saved(stage(spark, docs, sf), name)
        seen[name] = before, docs.collect()
        if name != "pack":
            assert docs.columns == COLUMNS
    before, after = seen["quality"]
    assert Counter(r.doc_id for r in after) <= Counter(r.doc_id for r in before) and all(not q._judged([r.text], q.fitted(np.zeros((0, 1)), np.zeros(0), []), 0.5)[1][0] for r in after)
    before, after = seen["lines"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    before, after = seen["near_duplicates"]
    order = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    first = set(roots([plain_fingerprint(r.text) for r in order]))
    assert Counter(r.doc_id for r in after) == Counter(order[k].doc_id for k in first)
    before, after = seen["mix"]
    own = Counter()
    for r in before:
        own[r.doc_id] += len(WORD.findall(r.text or ""))
    taken = Counter()
    for r in after:
        taken[r.doc_id] += len(WORD.findall(r.text or ""))
    assert all(taken[i] <= 3 * own[i] for i in taken) and abs(sum(taken.values()) - sum(own.values())) <= 20
    before, after = seen["pack"]
    check_sequences(after)
    assert sum(r.length for r in after) == sum(len(tokens(r.text)) for r in before)
    assert sorted(map(str, pipeline.run(spark, sf).collect())) == sorted(map(str, after))


def test_pipeline_of_nothing(spark, none, labels, tmp_path):
    sf = f"file://{tmp_path}"
    none.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    assert pipeline.run(spark, sf).collect() == []
