"""The entries job on literal documents: captured copies with their expected outputs, and cases that its parts have to stand."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import grid as G
from quire.operators.compare import same_plain
from quire.operators.derive import route_entries, to_entries
from quire.operators.nodes import docs_with, to_nodes, with_spans, with_tree
from quire.operators.splice import grid_tables


def tree(spark, *pages):
    return with_tree(with_spans(to_nodes(spark.createDataFrame(list(enumerate(pages, 1)), "doc_id long, html string"))))


def sorted_attributes(html):
    """Attribute order is the source's and says nothing."""
    return re.sub(r"<(\w+)((?: [\w-]+=\"[^\"]*\")+)>", lambda m: f"<{m[1]} {' '.join(sorted(re.findall(r'[\w-]+=\"[^\"]*\"', m[2])))}>", html)


ARIA_GRID = """<div role="grid" aria-rowcount="3" aria-colcount="3">
  <div role="row" aria-rowindex="1">
    <span role="columnheader" aria-colindex="1">Name</span>
    <span role="columnheader" aria-colindex="2">Role</span>
    <span role="columnheader" aria-colindex="3">Score</span>
  </div>
  <div role="row" aria-rowindex="2">
    <span role="gridcell" aria-colindex="1">Alice</span>
    <span role="gridcell" aria-colindex="2">Admin</span>
    <span role="gridcell" aria-colindex="3">98</span>
  </div>
  <div role="row" aria-rowindex="3">
    <span role="gridcell" aria-colindex="1">Bob</span>
    <span role="gridcell" aria-colindex="2">User</span>
    <span role="gridcell" aria-colindex="3">72</span>
  </div>
</div>
"""
ARIA_MARKDOWN = "| Name | Role | Score |\n| --- | --- | --- |\n| Alice | Admin | 98 |\n| Bob | User | 72 |"


SHEET_CELL = 'style="border: 1px solid rgb(204, 204, 204); overflow: hidden; padding: 2px 3px; vertical-align: bottom;"'


def sheet_row(*texts):
    cells = "".join(f'\n        <td {SHEET_CELL} data-sheets-value="{{&quot;1&quot;:2,&quot;2&quot;:&quot;{t}&quot;}}">{t}</td>' for t in texts)
    return f'\n      <tr style="height: 92px;">{cells}\n      </tr>'


# a copy out of the middle of a sheet
SHEET = ('<google-sheets-html-origin style="color: rgb(0, 0, 0); font-size: medium;">\n  <table xmlns="http://www.w3.org/1999/xhtml" cellspacing="0" cellpadding="0" dir="ltr" border="1">'
         '\n    <colgroup>\n      <col width="200">\n      <col width="200">\n    </colgroup>\n    <tbody>' + sheet_row("GitHub org", "abstract codebase") + sheet_row("npm package name", "unify documentation")
         + "\n    </tbody>\n  </table>\n</google-sheets-html-origin>\n")
# a headline card: wrapper divs around a menu, an icon and a thumbnail without names
CARD = ('<META charset="utf-8"><DIV class="m5k28" style="display: flex;"><DIV class="B6pJDd"><DIV class="IL9Cne"><DIV class="MCAGUe ">'
        '<DIV class="oovtQ"><BR class="Apple-interchange-newline"><IMG alt="" src="https://x.example/favicon?a=1&amp;b=2" loading="lazy" style="height: 14px; margin-right: 4px;">'
        '<DIV class="a7P8l"><DIV class="vr1PYe">Oilers Nation</DIV></DIV></DIV>'
        '<DIV class="hLNLFf"><DIV jscontroller="edeRg"><DIV class="VfPpkd"><DIV><SPAN><BUTTON aria-label="More"></BUTTON></SPAN></DIV><DIV jsname="U0exHf"></DIV></DIV></DIV></DIV></DIV>'
        '<A class="JtKRv" href="https://x.example/read/1?hl=en&amp;gl=CA" aria-label="Headline - Oilers Nation">Dickinson has &lsquo;unfinished business&rsquo;</A></DIV></DIV>'
        '<FIGURE aria-hidden="true"><IMG alt="" src="https://x.example/t.jpg" style="width: 64px; height: 64px"></FIGURE></DIV>'
        "<DIV><DIV>7 hours ago</DIV>\n  <HR><DIV>By Michael Menzies</DIV></DIV>")
# documents with their Markdown
MARKDOWN = [
    # rows spread over groups, header rows after body rows, text between cells
    ('<div role="rowgroup"><div role="row"><i role="cell">a</i> and <i role="cell">b</i></div></div><div role="rowgroup"><div role="row"><i role="columnheader">H</i><i role="cell">K</i></div></div>',
     "| H | K |\n| --- | --- |\n| a | b |"),
    # a table anywhere leaves the rows alone
    ('<div role="row"><span role="cell">a</span><span role="cell">b</span></div><table><tr><th>x</th></tr></table>', "ab\n\n| x |\n| --- |"),
    # a cell inside a cell is markup of the outer one
    ('<div role="row"><div role="cell">a <span role="cell">in</span></div><div role="cell">b</div></div>', "| a in | b |\n| --- | --- |"),
    # white space of pre, and the input's own marks
    ("<pre>a\n  b   c\n</pre>", "a\n  b   c"), ("<p>a \ue003 b\ue00f\ue010 c\ue000</p>", "a \ue003 b\ue00f\ue010 c\ue000"), ('<p><a href="u\ue008">t\ue009</a></p>', "[t\ue009](u\ue008)"),
    ("<p>x <code>a``` ` b</code></p>", "x ``a``` ` b``"), ("<p><code><code>n</code></code> <code>`</code></p>", "`n` `` ` ``"), ("<p>a\u0001b<br>c</p>", "a\u0001b  \nc"),
]


@pytest.fixture(scope="module")
def entries(spark):
    """All documents in one job: the captured copies, then those of MARKDOWN."""
    html = [ARIA_GRID, SHEET, CARD, *(h for h, _ in MARKDOWN)]
    return {r.doc_id: r for r in to_entries(spark.createDataFrame(list(enumerate(html)), "doc_id long, html string")).collect()}


def test_aria_grid_golden(entries):
    e = entries[0]
    assert e.markdown == ARIA_MARKDOWN and e.source_type == "HTML (Extracted ARIA Table)" and e.derived_from == "text/html"
    assert e.simple_html.count("<tr>") == 3 and e.simple_html.count("<th>") == 3 and "role" not in e.simple_html


def test_spreadsheet_golden(entries):
    """Vendor tags and styles go, and no header row is invented in the Simple HTML."""
    e = entries[1]
    assert e.markdown == "| GitHub org | abstract codebase |\n| --- | --- |\n| npm package name | unify documentation |"
    assert e.simple_html.strip() == "<table><tr><td>GitHub org</td><td>abstract codebase</td></tr><tr><td>npm package name</td><td>unify documentation</td></tr></table>"
    assert e.source_type == "HTML"


def test_news_card_golden(entries):
    """Empty wrappers collapse, icon and thumbnail are named, their drawn size is kept."""
    e = entries[2]
    assert e.markdown == ("![image…](https://x.example/favicon?a=1&b=2)\n\nOilers Nation\n\n[Dickinson has ‘unfinished business’](https://x.example/read/1?hl=en&gl=CA)\n\n"
                          "![image…](https://x.example/t.jpg)\n\n7 hours ago\n\n* * *\n\nBy Michael Menzies")
    assert "button" not in e.simple_html and "class" not in e.simple_html and "<div></div>" not in e.simple_html
    assert sorted_attributes('<img alt="image…" height="14" src="https://x.example/favicon?a=1&amp;b=2">') in sorted_attributes(e.simple_html)
    assert sorted_attributes('<img alt="image…" height="64" src="https://x.example/t.jpg" width="64">') in sorted_attributes(e.simple_html)


def test_markdown_of_documents(entries):
    assert [entries[3 + k].markdown for k in range(len(MARKDOWN))] == [m for _, m in MARKDOWN]


def test_grids_of_many_documents(spark):
    """Swap, wrong count, layout guard, injection and no grid, in one job; payloads without a match stay as they are. The grid
    of document 7 is selected whole on its page."""
    payloads = spark.createDataFrame([
        (1, "<p>a</p><table><tr><td>old<table><tr><td>inner</td></tr></table></td></tr></table><table><tr><td>two</td></tr></table><p>z</p>"), (2, "<table><tr><td>one</td></tr></table>"),
        (3, "<p>text</p>"), (4, "<p>plain</p>"), (5, None), (6, "<table><tr><td>kept</td></tr></table>"), (7, ARIA_GRID)], "doc_id long, html string")
    grids = spark.createDataFrame([
        (1, "native", [(0, 1, "<table><tr><th>n1</th></tr></table>"), (1, 1, "<table><tr><th>gone</th></tr></table>"), (2, 1, "<table><tr><th>n3</th></tr></table>")]),
        (2, "native", [(0, 1, "<table><tr><th>x</th></tr></table>"), (1, 1, "<table><tr><th>y</th></tr></table>")]),
        (3, "aria", [(0, 1, "<table><thead><tr><th>g</th></tr></thead><tbody></tbody></table>")]),
        (5, "aria", [(0, 1, "<table><thead><tr><th>five</th></tr></thead></table>")]),
        (6, "aria", [(0, 1, "<table><tr><th>no</th></tr></table>")])], "doc_id long, grid_type string, tables array<struct<table_no:int,width:int,html:string>>")
    cells = G.aria_cells(tree(spark, ARIA_GRID)).withColumn("selected", F.lit(True))
    page = grid_tables(G.repair_grid(G.first_root(cells))).withColumn("doc_id", F.lit(7).cast("long"))
    got = {r.doc_id: r for r in to_entries(payloads, grids=grids.unionByName(page)).collect()}
    assert got[1].simple_html == "<p>a</p><table><tr><th>n1</th></tr></table><table><tr><th>n3</th></tr></table><p>z</p>"
    assert got[2].simple_html == "<table><tr><td>one</td></tr></table>" and got[4].simple_html == "<p>plain</p>" and got[6].simple_html == "<table><tr><td>kept</td></tr></table>"
    assert got[3].markdown == "| g |\n| --- |" and got[5].markdown == "| five |\n| --- |" and got[7].markdown == ARIA_MARKDOWN and len(got) == 7


def test_routes_read_their_payloads_once(spark):
    p = spark.createDataFrame([(1, "<b>x</b>", "x"), (2, None, "a\tb\n1\t2"), (3, None, "words"), (4, None, None), (5, "", "k\tv\n1\t2")], "doc_id long, html string, plain string")
    routed = route_entries(p)
    plan = routed._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in routed.collect()}
    assert [got[k].route for k in range(1, 6)] == ["html", "tsv", "plain", "none", "tsv"]
    assert got[1].markdown == "**x**" and got[3].markdown == "words" and got[3].simple_html == "" and got[4].markdown == "" and got[2].markdown.startswith("| a | b |")
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_box_is_built_from_sparse_cells(spark):
    cells = spark.createDataFrame([(1, 0, 2, 1, "a", True, True), (1, 0, 5, 900, "z", False, True), (1, 0, 2, 3, "unselected", True, False), (1, 0, 0, 0, "outside", False, False), (2, 0, 0, 0, "no", False, False)],
                                  "doc_id long, table_no int, r int, c int, text string, is_header boolean, selected boolean")
    got = {(r.doc_id, r.r, r.c): (r.text, r.is_header) for r in G.repair_grid(cells).collect()}
    assert len(got) == 4 * 900 and got[1, 0, 0] == ("a", True) and got[1, 0, 2] == ("", True) and got[1, 3, 899] == ("z", False) and got[1, 1, 0] == ("", False)


def test_selection_overlap(spark):
    import random
    r = random.Random(8)
    els = [(d, p, p + r.randint(0, 6)) for d in range(6) for p in range(0, 60, 2)]
    sels = [(d, a, a + r.randint(0, 9)) for d in range(5) for a in (r.randint(0, 60) for _ in range(3))]
    got = G.mark_selected(spark.createDataFrame(els, "doc_id long, pos long, end_pos long"), spark.createDataFrame(sels, "doc_id long, start_pos long, end_pos long")).collect()
    want = Counter((d, p, e, any(d == x and p <= b and e >= a for x, a, b in sels)) for d, p, e in els)
    assert Counter((x.doc_id, x.pos, x.end_pos, x.selected) for x in got) == want


def test_implied_ends_and_dropped_subtrees(one):
    from quire.functions.markup import with_implied_ends, without_subtrees
    ends = lambda h: one(with_implied_ends(F.col("x")), x=h)
    assert ends("<table><tr><td>1<td>2<tr><td>3</table>x") == "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>x"
    assert ends("<ul><li>a<ol><li>b</ol><li>c</ul>") == "<ul><li>a<ol><li>b</li></ol></li><li>c</li></ul>"
    assert ends("<p>a<p>b<div>c</div>") == "<p>a</p><p>b</p><div>c</div>"
    assert ends("<table><tr><td><p>a<table><tr><td>b</table>c<td>d</table>") == "<table><tr><td><p>a</p><table><tr><td>b</td></tr></table>c</td><td>d</td></tr></table>"
    assert ends("<dl><dt>a<dd>b<dt>c</dl>") == "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>" and ends("<ul><li>open") == "<ul><li>open</li></ul>"
    same = "<ul><li>a</li></ul><p>x</p><table><tr><td>y</td></tr></table>"
    assert ends(same) == same and ends("") == "" and ends(None) is None
    gone = lambda h: one(without_subtrees(F.col("x"), ["object", "svg"]), x=h)
    assert gone("<object>a<object>b</object>c</object>d<svg/>e<SVG a='1'><g></SVG>f") == "def"
    assert gone("x<svg>y") == "x<svg>y" and gone("a<svg>b</svg>c<svg>d") == "ac<svg>d" and gone(None) is None


def test_small_library_functions(spark, one, tmp_path):
    from quire.sources import payloads as P
    spark.createDataFrame([(7, "<p>x</p>")], "page_id int, body string").write.parquet(f"file://{tmp_path}/store")
    got = P.read_payloads(spark, f"file://{tmp_path}/store", mapping={"doc_id": "page_id", "html": "body"}).first()
    assert got.doc_id == 7 and got.html == "<p>x</p>" and got.plain is None and got.extras == []
    for slug in ("a", "b"):
        (tmp_path / "corpus" / slug).mkdir(parents=True)
        (tmp_path / "corpus" / slug / "input.html").write_text(f"<p>{slug}</p>")
    (tmp_path / "corpus" / "a" / "expected.md").write_text("a")
    found = {r.slug: r for r in P.read_corpus_dir(spark, f"file://{tmp_path}/corpus").collect()}
    assert found["a"].expected_md == "a" and found["b"].expected_md is None and found["b"].input_html == "<p>b</p>"
    assert one(same_plain(F.col("x"), F.col("y")), x="a\r\nb \n", y="a\nb") and not one(same_plain(F.col("x"), F.col("y")), x="a", y="b")
    n = to_nodes(spark.createDataFrame([(1, "<table></table>"), (2, "<p>x</p>"), (3, "<table><table>")], "doc_id long, html string"))
    assert {r.doc_id for r in docs_with(n, F.col("tag") == "table").collect()} == {1, 3}


def test_dedup_over_horizons(spark):
    """Equal entries inside the horizon of the last sighting go, also across runs from one checkpoint; state expires."""
    import datetime as dt

    from quire.streaming import jobs as J
    run = J.new_run_dir(spark, "dedup-test")
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    parts = [[(0, "a"), (1, "a"), (3, "b"), (9, "c")], [(12, "a"), (14, "a"), (22, "a"), (30, "d")], [(40, "a"), (41, "b"), (70, "e")], [(100, "f"), (101, "f")]]
    for rows in parts:
        stream = J.land(spark.createDataFrame([(at(h), k) for h, k in rows], "ts timestamp, key string").coalesce(1), f"{run}/in")
        q = J.dedup_stream(stream, ["key"], "ts", 10 * 3600, "1 minute", f"{run}/out", f"{run}/ckpt")
    got = sorted((r.ts, r.key) for r in spark.read.parquet(f"{run}/out").collect())
    want, seen = [], {}
    for h, k in (x for rows in parts for x in rows):
        if k not in seen or h - seen[k] > 10:
            want.append((at(h), k))
        seen[k] = h
    assert got == sorted(want)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # keys of passed horizons are gone
