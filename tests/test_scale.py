"""What keeps the document jobs linear and their tasks small: exact counts of tokens, no frame that is read anew for each token,
few sorts and aggregates, and payloads of megabytes that are never many at a time."""

import glob
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.operators.derive import to_entries, to_markdown, to_simple_html
from quire.operators.nodes import following, markup_size, to_nodes, with_spans, with_tree
from quire.operators.render_md import render_markdown
from quire.operators.repair import with_holds
from quire.plans.q_markdown import markdown_of
from quire.streaming import jobs as J


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "<p>x <a href='u'></a></p>")], "doc_id long, html string")


def test_tokens_are_counted_as_they_are(spark):
    """A text of a megabyte is one token and 4096 for its bytes; tags side by side have no text between them."""
    d = spark.createDataFrame([(1, "<pre>" + "x " * (1 << 19) + "</pre>"), (2, "<tr><td>a</td><td></td></tr>" * 100)], "doc_id long, html string")
    size = {r.doc_id: r.n for r in d.select("doc_id", markup_size(F.col("html")).alias("n")).collect()}
    rows = {r.doc_id: r["count"] for r in to_nodes(d).groupBy("doc_id").count().collect()}
    assert rows == {1: 3, 2: 700}
    assert size[1] == pytest.approx(4100, abs=2) and size[2] == pytest.approx(700 + 2800 / 256 + 1, abs=1)


def test_no_frame_is_read_anew_for_each_token(docs):
    for df in (markdown_of(docs), to_simple_html(docs), to_entries(docs)):
        assert "RowFrame, 1, unboundedfollowing" not in _plan(df)


def test_following_is_the_next_value(spark):
    rows = [(d, p, v) for d in range(3) for p, v in enumerate([None, 1, None, None, 4, 5, None][d:])]
    got = spark.createDataFrame(rows, "doc_id long, pos int, v int").withColumn("n", following("v")).collect()
    for r in got:
        assert r.n == next((v for d, p, v in rows if d == r.doc_id and p > r.pos and v is not None), None)


def test_an_element_holds_what_stands_inside(spark):
    html = "<div><div></div><i>a<b></b></i></div><b>x</b><p><i> </i></p></i><div>"
    n = with_spans(to_nodes(spark.createDataFrame([(1, html)], "doc_id long, html string")))
    rows = sorted(with_holds(n, b=F.col("tag") == "b", text=(F.col("kind") == "text") & (F.col("text") != " ")).collect(), key=lambda r: r.pos)
    for r in rows:
        span = (r.pos, r.end_pos) if r.kind == "open" else (r.open_pos, r.pos)
        if r.kind not in ("open", "close") or None in span:
            assert r.holds_b is None and r.holds_text is None
            continue
        inside = [x for x in rows if span[0] < x.pos < span[1]]
        assert r.holds_b == any(x.tag == "b" for x in inside) and r.holds_text == any(x.kind == "text" and x.text != " " for x in inside)


def test_items_are_numbered_in_the_order_of_the_tree(spark):
    html = "<ol><li>a</li> <p></p><li>b<ol><li>c</li></ol></li></ol><li>d</li><ul><li>e<br><li>f</li></li></ul><li>g</li>"
    n = with_spans(to_nodes(spark.createDataFrame([(1, html)], "doc_id long, html string")))
    rows = sorted(with_tree(n, items=True).collect(), key=lambda r: r.pos)
    for r in rows:
        before = [x for x in rows if x.parent_pos == r.parent_pos and x.pos < r.pos]
        if r.kind == "open" and r.tag == "li":
            assert r._li_idx == 1 + sum(x.kind == "open" and x.tag == "li" for x in before)
        else:
            assert r._li_idx is None


def test_documents_that_share_a_key(spark):
    """Two rows with one doc_id are one document whose tokens stand twice: an emptied link goes, a link gets its name once."""
    html = '<p>x<a href="u"> <img src="i" width="1" height="1"> </a></p><a href="v" title="name"></a>'
    d = spark.createDataFrame([(1, html), (1, html)], "doc_id long, html string")
    assert [r.simple_html for r in to_simple_html(d).collect()] == [
        '<p><p>xx</p></p><a href="v" title="name"><a href="v" title="name"></a>name…</a>']


def test_sorts_and_aggregates_of_a_job(docs):
    """Sorts were 34, 24 and 28, aggregates (partial and final) 10 for Markdown."""
    for df, sorts in ((to_entries(docs), 26), (to_markdown(docs), 18), (to_simple_html(docs), 21)):
        assert _plan(df).count("Sort [") <= sorts
    assert _plan(markdown_of(docs)).count("ObjectHashAggregate(") <= 6


def test_cells_of_many_segments(spark):
    """Parts of one cell are its lines, rows without a cell and tables side by side stay apart."""
    html = ("<table><tr><th>H</th><th><p>a</p><p></p><p>b</p></th></tr><tr></tr><tr><td><ul><li>x</li><li>y</li></ul></td><td></td></tr></table>"
            "<table><tr><td>1</td></tr><tr><td><b>2</b></td><td>3</td></tr></table><table></table><p>end</p>")
    t = with_tree(with_spans(to_nodes(spark.createDataFrame([(1, html)], "doc_id long, html string"), doc_marker=True)))
    assert render_markdown(t).first()["markdown"] == (
        "| H | a<br>b |\n| --- | --- |\n| *   x<br>*   y |  |\n\n| 1 |\n| --- |\n| **2** | 3 |\n\nend")


def test_payload_files_are_read_a_few_rows_at_a_time(spark):
    """Every file of landed and sorted out payloads has row groups of ``PAYLOAD_ROWS`` rows at most."""
    top = tempfile.mkdtemp(prefix="quire-payloads-")
    df = spark.range(0, 400, numPartitions=2).select("id", F.repeat(F.lit("x"), F.when(F.col("id") % 5 == 0, 20).otherwise(2)).alias("plain"))
    stream = J.land(df, f"{top}/in", payloads=True)
    J.dead_letter(stream, lambda b: F.when(F.length("plain") > 10, F.lit("oversize")), f"{top}/main", f"{top}/dead", f"{top}/ckpt")
    assert spark.read.parquet(f"{top}/main").count() == 320 and spark.read.parquet(f"{top}/dead").count() == 80
    for sink in ("in", "main", "dead"):
        groups = [m.row_group(i).num_rows for f in glob.glob(f"{top}/{sink}/**/*.parquet", recursive=True) for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
        assert groups and max(groups) <= J.PAYLOAD_ROWS
