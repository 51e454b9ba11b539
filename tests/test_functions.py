"""Literal cases from the reference's unit tests, retyped as rows (TSV, style policy, sizes, escapes)."""

import pytest
from pyspark.sql import functions as F

from quire.functions import style as ST
from quire.functions import tsv as T
from quire.functions.text import format_bytes, md_escape, normalize_text, redact_base64
from quire.operators.compare import stale_check



@pytest.mark.parametrize("html,plain,expected", [
    ("<p>x</p>", "a\tb\n1\t2", False),
    (None, "", False),
    (None, "a\tb", False),
    (None, "no tabs here\nstill none", False),
    (None, "Name\tAge\nAlice\t30\nBob\t25", True),
    (None, "a\tb\r\n1\t2\r\n", True),
])
def test_is_tsv(one, html, plain, expected):
    assert one(T.is_tsv(F.col("h"), F.col("p")), h=html, p=plain) is expected


def test_tsv_markdown_exact(one):
    md = one(T.tsv_to_markdown(F.col("x")), x="Name\tAge\nAlice\t30\nBob\t25")
    assert md == "| Name | Age |\n| --- | --- |\n| Alice | 30 |\n| Bob | 25 |\n"


def test_tsv_pad_and_truncate(one):
    assert "| 1 | 2 |  |" in one(T.tsv_to_markdown(F.col("x")), x="a\tb\tc\n1\t2")
    lines = one(T.tsv_to_markdown(F.col("x")), x="a\tb\n1\t2\t3\t4").split("\n")
    assert [l for l in lines if l.startswith("| 1")] == ["| 1 | 2 |"]
    assert "| 1 | 2 |" in one(T.tsv_to_markdown(F.col("x")), x="a\tb\r\n1\t2\r\n")


def test_tsv_html_escapes(one):
    h = one(T.tsv_to_html(F.col("x")), x="a<b\tc&d\n1>0\t2")
    assert '<th style="font-weight: normal;">a&lt;b</th>' in h and "<td>1&gt;0</td>" in h and "c&amp;d" in h


ALLOWED = [("background-color", "rgb(255, 255, 0)"), ("font-family", '"Bree Serif"'), ("font-size", "16pt"),
           ("border", "1px solid rgb(204, 204, 204)"), ("padding", "2px 3px"), ("font-family", "url, sans-serif"),
           ("background-image", "none"), ("background-image", "linear-gradient(red, blue)"),
           ("position", "absolute"), ("position", "relative"), ("z-index", "9999")]
REFUSED = [("background-image", "url(http://tracker.test/b.png)"), ("cursor", "url(http://tracker.test/c.cur), auto"),
           ("background-image", "url(data:image/gif;base64,R0lGOD)"),
           ("background-image", 'image-set("//tracker.test/b.png" 1x)'),
           ("background-image", "cross-fade(url(a.png), url(b.png), 50%)"), ("background-image", "element(#src)"),
           ("background-image", "paint(worklet)"), ("width", "expression(alert(1))"),
           ("-moz-binding", "url(x.xml#y)"), ("position", "fixed"), ("position", "  fixed  "), ("position", "FIXED"),
           ("position", "-webkit-sticky"), ("--border-neutral", "transparent"), ("background-image/*x*/", "red"),
           ("color;background", "red"), ("9color", "red"), ("", "red"), ("color", ""), ("color", None)]


@pytest.mark.parametrize("prop,value", ALLOWED)
def test_style_allowed(one, prop, value):
    assert one(ST.style_allowed(F.col("p"), F.col("v")), p=prop, v=value) is True


@pytest.mark.parametrize("prop,value", REFUSED)
def test_style_refused(one, prop, value):
    assert one(ST.style_allowed(F.col("p"), F.col("v")), p=prop, v=value) is False


def test_style_rebuild(spark):
    df = spark.createDataFrame([(1, "color: red !important; background: url(x.png); padding: 2px")],
                               "doc_id long, style string")
    assert ST.rebuild_style(ST.style_audit(df)).first()["style"] == "color: red !important; padding: 2px"


@pytest.mark.parametrize("n,expected", [(None, "0 B"), ("0", "0 B"), ("1", "1 B"), ("1023", "1023 B"),
                                        ("1024", "1 KB"), ("1536", "1.5 KB"), ("1048576", "1 MB"),
                                        ("5000000000000000", "4547.5 TB")])
def test_format_bytes(one, n, expected):
    assert one(format_bytes(F.col("x").cast("long")), x=n) == expected


def test_escape_order(one):
    assert one(md_escape(F.col("x")), x="- *a* [b] _c_ `d` \\") == "\\- \\*a\\* \\[b\\] \\_c\\_ \\`d\\` \\\\"
    assert one(md_escape(F.col("x")), x="1. item") == "1\\. item"
    assert one(md_escape(F.col("x")), x="## h") == "\\## h"
    assert one(md_escape(F.col("x")), x="a | b") == "a | b"


@pytest.mark.parametrize("x", ["- *a* [b] _c_ `d` \\", "1. item", "## h", "+ plus", "=== x", "~~~ y", "> q",
                               "\\*-_", "12. a_b", "#nospace", "-", "", "a\\b*c"])
def test_escape_fast_path_equals_table(one, x):
    from quire.functions.text import md_escape_table
    assert one(md_escape(F.col("x")), x=x) == one(md_escape_table(F.col("x")), x=x)


def test_redact_and_normalize(one):
    assert one(redact_base64(F.col("x")), x='<img src="data:image/png;base64,AAAA==">') == \
        '<img src="data:image/png;base64,[IMAGE_BINARY]">'
    assert one(normalize_text(F.col("x")), x="a\r\nb  \r\n") == "a\nb"


def test_stale_check(spark):
    df = spark.createDataFrame([
        ("alpha beta gamma delta", "alpha beta gamma delta epsilon", False),
        ("alpha beta gamma", "totally different words here", False),
        ("alpha beta", "zzz alpha", True),
        ("", "anything", False),
    ], "s string, c string, t boolean")
    out = [r["r"] for r in df.select(stale_check(F.col("s"), F.col("c"), F.col("t")).alias("r")).collect()]
    assert [(o.match_count, o.needed, o.is_stale) for o in out[:3]] == [(4, 3, False), (0, 3, True), (1, 1, False)]
    assert out[3].checked is False and out[3].is_stale is False
