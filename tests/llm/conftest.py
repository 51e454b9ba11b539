"""Small tables with the cases that every operator has to stand: nulls in any column, empty and very long texts, ties and
repeated rows, an empty table, and columns whose names clash with those that operators use inside."""

import random

import pytest

CLASHING = ["part", "row", "size", "key", "n", "w", "grams", "fp", "root", "bucket", "taken", "target", "line", "pos", "site", "score", "kept", "_own", "_span", "unit", "ids"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijéß", k=r.randint(2, 8))) for _ in range(60)]
    out = []
    for k in range(n):
        out.append(r.choice(words) + ("".join(r.choices("xyz", k=5)) if k % 3 else ""))
        out.append("\n" if r.random() < 0.1 else " ")
    return "".join(out)


@pytest.fixture(scope="session")
def rows():
    long = prose(1, 30_000)
    base = prose(2, 300)
    words = base.split(" ")
    edited = " ".join(w if i % 40 else w + "q" for i, w in enumerate(words))
    texts = [
        (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "One  TWO three four"), (5, long), (6, long[1000:]), (7, base), (8, base), (9, edited),
        (10, prose(3, 200) + " " + base[:600] + " " + prose(4, 100)), (11, "a" * 5000), (12, "a" * 5000), (13, "la " * 400), (14, "line of noise\n" * 30),
        (15, "日本語 " * 100), (16, prose(5, 120)), (16, prose(6, 120)), (17, prose(7, 90)), (17, prose(7, 90)), (None, base), (None, prose(8, 80)), (18, "# $ % | < >" * 40),
        (19, "Released under the MIT License.\n" + prose(9, 70)), (20, "Licensed under the Apache License, Version 2.0.\n\nAll rights reserved.\n" + prose(10, 60)),
    ]
    texts += [(100 + k, "shared boilerplate line\n" + prose(100 + k, 60)) for k in range(30)]
    sources = ["b", None, "a", "é", "Z", "aa", "c", "d", "e", "f", "g", "h", "i"]
    return [(i, t, None if k % 7 == 0 else "en", sources[k % len(sources)], None if k % 5 == 0 else len(t or "")) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, rows):
    return spark.createDataFrame([(*r, *(None if k % 2 else "x" for k in range(len(CLASHING)))) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    found = [(k, k % 2, 0) for k in range(100, 130)] + [(None, 1, 0), (7, None, 0), (16, 1, 1), (16, 0, 0), (18, 0, 0)]
    return spark.createDataFrame(found, "doc_id long, quality long, toxic long")
