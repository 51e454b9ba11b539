"""Plan-shape checks behind the scale design: one doc_id exchange per document pipeline, none on bucketed
input, bounded broadcasts only."""

import tempfile

from quire.operators.nodes import to_nodes, with_spans, with_tree
from quire.operators.policy import sanitize
from quire.operators.render_md import render_markdown
from quire.plans.q_markdown import pages_payloads

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_markdown_job_has_one_exchange(spark):
    p = pages_payloads(spark, SF)
    md = render_markdown(with_tree(with_spans(sanitize(to_nodes(p, doc_marker=True)))))
    plan = _plan(md)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "doc_id" in plan[plan.index("Exchange hashpartitioning"):][:80]
    assert "BroadcastExchange" not in plan and "CartesianProduct" not in plan


def test_bucketed_payloads_need_no_exchange(spark):
    p = pages_payloads(spark, SF).select("doc_id", "html")
    path = tempfile.mkdtemp(prefix="quire-bucketed-")
    p.write.mode("overwrite").bucketBy(4, "doc_id").option("path", path).saveAsTable("quire_bucketed_pages")
    try:
        b = spark.table("quire_bucketed_pages")
        md = render_markdown(with_tree(with_spans(sanitize(to_nodes(b, doc_marker=True, prepartitioned=True)))))
        assert "Exchange" not in _plan(md)
        expected = {r.doc_id: r.markdown for r in render_markdown(
            with_tree(with_spans(sanitize(to_nodes(p, doc_marker=True))))).collect()}
        assert {r.doc_id: r.markdown for r in md.collect()} == expected
    finally:
        spark.sql("DROP TABLE IF EXISTS quire_bucketed_pages")


def _joins(plan: str) -> bool:
    return any(j in plan for j in ("HashJoin", "SortMergeJoin", "NestedLoopJoin", "CartesianProduct"))


def test_single_flows_have_one_exchange(spark):
    """Grids, selections, subtree text and the entries job: one exchange by document, one scan a side, no join of a relation
    with what was computed from it."""
    from pyspark.sql import functions as F

    from quire.operators import grid as G
    from quire.operators.derive import to_entries
    from quire.operators.nodes import subtree_text
    p = pages_payloads(spark, SF)
    plan = _plan(subtree_text(with_spans(to_nodes(p)), F.col("tag").isin("h1", "a", "li")))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and not _joins(plan)
    plan = _plan(to_entries(p))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and not _joins(plan) and "InMemoryTableScan" not in plan
    cells = spark.createDataFrame([], "doc_id long, table_no int, r int, c int, text string, is_header boolean, selected boolean, strategy string")
    for df in (G.repair_grid(cells), G.swap_tables(cells, cells), G.width_guard(cells, cells), G.pick_strategy(cells), G.first_root(cells)):
        plan = _plan(df)
        assert plan.count("Exchange") <= 1 and not _joins(plan)
    spans = spark.createDataFrame([], "doc_id long, pos long, end_pos long, start_pos long")
    plan = _plan(G.mark_selected(spans.select("doc_id", "pos", "end_pos"), spans.select("doc_id", "start_pos", "end_pos")))
    assert plan.count("Exchange") == 1 and not _joins(plan)
