"""Markdown rendering of literal documents (golden strings)."""

import pytest

from quire.plans.q_markdown import markdown_of


def render(spark, html):
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    return markdown_of(df).first()["markdown"]


@pytest.mark.parametrize("html,expected", [
    ("<h1>Title</h1><p>Body</p>", "# Title\n\nBody"),
    ("<p>a<br>b</p>", "a  \nb"),
    ("<ul><li>one</li><li>two</li></ul>", "*   one\n*   two"),
    ("<ol><li>one</li><li>two</li></ol>", "1.  one\n2.  two"),
    ("<p><b>bold</b> and <i>it</i></p>", "**bold** and _it_"),
    ("<p><b> x </b>y</p>", "**x** y"),
    ('<p><a href="/u(1)">link</a></p>', "[link](/u\\(1\\))"),
    ('<p><img src="a.png" alt="A"></p>', "![A](a.png)"),
    ("<p>x</p><hr><p>y</p>", "x\n\n* * *\n\ny"),
    ("<blockquote><p>q</p></blockquote>", "> q"),
    ("<p>- not a list</p>", "\\- not a list"),
    ("<script>var x = '</p>';</script><p>kept</p><!-- gone -->", "kept"),
    ('<a href="https://x.example"><div>source</div>\n<div>lang</div></a>', "[source — lang](https://x.example)"),
    ("<p>&lt;tag&gt; &amp; more</p>", "<tag> & more"),
    ("<p>A&#8217;s &eacute;t&#xE9; &amp;lt; &#38;amp; R&D &nope; &#0;</p>", "A\u2019s \u00e9t\u00e9 &lt; &amp; R&D &nope; \ufffd"),
    ("", ""),
])
def test_markdown(spark, html, expected):
    assert render(spark, html) == expected


@pytest.mark.parametrize("html,expected", [
    ("<pre><code>a\n```\nb\n</code></pre>", "````\na\n```\nb\n````"),
    ("<p>x <code>a*b</code> y</p>", "x `a*b` y"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
    ("<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>x<br>y</td></tr></tbody></table>",
     "| h |\n| --- |\n| x<br>y |"),
    ('<p><img src="t.gif" width="1" height="1">text</p>', "text"),
    ('<a href="https://x"><svg></svg></a>', "[image…](https://x)"),
    ('<a href="https://x" aria-label="Open the thing"></a>', '[Open…](https://x "Open the thing")'),
])
def test_entries_markdown(spark, html, expected):
    from quire.operators.derive import to_markdown
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    assert to_markdown(df).first()["markdown"] == expected


def test_options_and_rules(spark):
    from quire.operators import rules as RU
    from quire.operators.nodes import to_nodes, with_spans, with_tree
    from quire.operators.render_md import render_markdown
    df = spark.createDataFrame([(1, "<h1>Title</h1><h3>Sub</h3><ul><li>a</li></ul><p><del>old</del> <b>new</b></p>"
                                   "<nav>menu</nav>")], "doc_id long, html string")
    tree = with_tree(with_spans(to_nodes(df, doc_marker=True)))
    md = render_markdown(tree, options={"heading_style": "setext", "bullet": "-"}).first()["markdown"]
    assert md.startswith("Title\n=====\n\n### Sub\n\n-   a")
    rules = RU.use(RU.rule_set(spark, [("nav", "remove", "", "", 5), ("b", "replace", "<", ">", 5)]),
                   RU.gfm_strikethrough(spark))
    md = render_markdown(tree, rules=rules).first()["markdown"]
    assert md.endswith("~old~ <new>") and "menu" not in md


def test_simple_html(spark):
    from quire.operators.derive import to_simple_html
    html = ('<div><div><div></div> <section> </section></div><div><div><p>x</p></div></div>'
            '<table><tbody><tr><td>1</td></tr></tbody></table><b style="font-weight:normal">plain</b></div>')
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    assert to_simple_html(df).first()["simple_html"] == \
        "<div><div><p>x</p></div><table><tr><td>1</td></tr></table>plain</div>"


@pytest.mark.parametrize("html,expected", [
    ("<table><tr><th>H</th></tr><tr><td><p>hello</p></td></tr></table>", "| H |\n| --- |\n| hello |"),
    ("<table><tr><th>H</th></tr><tr><td>a<ul><li>b</li></ul>c</td></tr></table>", "| H |\n| --- |\n| a<br>*   b<br>c |"),
    ("<blockquote><p>one</p><p>two</p></blockquote>", "> one\n> \n> two"),
    ("<blockquote><p>one</p></blockquote><blockquote><p>two</p></blockquote>", "> one\n\n> two"),
    ("<ol><li>b</li></ol><ul><li>c</li></ul>", "1.  b\n\n*   c"),
    ("<ul><li><p>one</p></li><li><p>two</p></li></ul><p>after</p>", "*   one\n    \n*   two\n    \n\nafter"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "*   a\n    \n    b"),
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "*   a\n    *   b\n*   c"),
    ("<ol>" + "".join(f"<li>i{k}<br>x</li>" for k in range(10)) + "</ol>",
     "\n".join(f"{k + 1}.  i{k}  \n{' ' * len(f'{k + 1}.  ')}x" for k in range(10))),
    ("<p><code>a`b</code> <code>plain</code></p>", "``a`b`` `plain`"),
    ("<p><code>`x``</code></p>", "``` `x`` ```"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>x<table><tr><th>n</th></tr><tr><td>v</td></tr></table>tail</td>"
     "<td>after</td></tr><tr><td>r2</td><td>r3</td></tr></table>",
     "| A | B |\n| --- | --- |\n| x<br>tail | after |\n| r2 | r3 |\n\n| n |\n| --- |\n| v |"),
])
def test_blocks_in_cells_lists_and_quotes(spark, html, expected):
    assert render(spark, html) == expected


def test_canonical_form_ignores_line_ends_around(spark):
    from quire.operators.compare import same_entry
    df = spark.createDataFrame([(1, "\n<p>x</p>\n", "<p>x</p>"), (2, "<p>x</p>", "<p>y</p>")], "doc_id long, left_html string, right_html string")
    assert {r.doc_id: r.same for r in same_entry(df).collect()} == {1: True, 2: False}


def test_nested_tables_keep_their_own_cells(spark):
    from quire.operators.derive import to_simple_html
    from quire.operators.grid import native_cells
    from quire.operators.nodes import to_nodes, with_spans, with_tree
    from quire.operators.repair import table_headers
    html = ("<table><tbody><tr><td>a<table><tr><th>n</th></tr></table> tail</td><td>b</td></tr></tbody>"
            "<tbody><tr><td>c</td><td>d</td></tr></tbody></table>")
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    tree = with_tree(with_spans(to_nodes(df)))
    got = sorted((r.table_no, r.r, r.c, r.text) for r in native_cells(tree).collect())
    assert got == [(0, 0, 0, "a tail"), (0, 0, 1, "b"), (0, 1, 0, "c"), (0, 1, 1, "d"), (1, 0, 0, "n")]
    assert [r.has_header for r in table_headers(tree).orderBy("table_pos").collect()] == [False, True]
    out = to_simple_html(df).first()["simple_html"]
    assert "<tbody>" not in out and "</tbody>" not in out
