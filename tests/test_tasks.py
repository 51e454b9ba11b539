"""How much markup one task is dealt: the payloads are small and compress well, their tokens are neither."""

from pyspark.sql import functions as F

from quire.operators.derive import route_entries, to_entries, to_markdown, to_simple_html
from quire.operators.nodes import TASK_TOKENS, tasks_for, to_nodes
from quire.operators.splice import spliced_nodes, with_grids

CELLS = "<tr><td>a</td><td>b</td></tr>" * 10


def _most_rows_of_a_task(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_follow_the_tokens(spark):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit(f"<table>{CELLS}</table>").alias("html"))
    nodes = to_nodes(docs)
    assert nodes.count() == 2500 * 82 > 3 * TASK_TOKENS
    assert _most_rows_of_a_task(nodes) < 1.5 * TASK_TOKENS


def test_tasks_count_the_grids_of_the_page(spark):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("<p>x</p>").alias("html"))
    tables = F.array(F.struct(F.lit(0).alias("table_no"), F.lit(2).alias("width"), F.lit(f"<table>{CELLS}</table>").alias("html")))
    grids = docs.select("doc_id", F.lit("aria").alias("grid_type"), tables.alias("tables"))
    joined, tasks = with_grids(docs, grids)
    assert tasks > 3
    nodes = spliced_nodes(joined, tasks)
    assert nodes.count() == 2500 * 83
    assert _most_rows_of_a_task(nodes) < 1.5 * TASK_TOKENS


def test_no_payload_at_all(spark):
    assert tasks_for(0) == 2
    assert to_nodes(spark.createDataFrame([], "doc_id long, html string")).count() == 0
    assert to_nodes(spark.createDataFrame([(1, None)], "doc_id long, html string"), doc_marker=True).count() == 1


def _most_sorts_of_a_stage(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return max(sum("Sort [" in line for line in stage.splitlines()) for stage in plan.split("Exchange hashpartitioning"))


def test_sorts_of_spliced_entries_are_divided(spark):
    """Each sort takes a page of 64 MB: 32 of them are 2 GB of a task."""
    docs = spark.createDataFrame([(1, "<p>x</p>", None)], "doc_id long, html string, plain string")
    tables = F.array(F.struct(F.lit(0).alias("table_no"), F.lit(2).alias("width"), F.lit(f"<table>{CELLS}</table>").alias("html")))
    grids = docs.select("doc_id", F.lit("aria").alias("grid_type"), tables.alias("tables"))
    for df in (to_entries(docs, grids=grids), route_entries(docs, grids)):
        assert _most_sorts_of_a_stage(df) <= 32
        assert df.count() == 1


def test_sorts_of_one_exchange_fit_a_task(spark):
    """Without grids the job is one stage; its sorts were 41, 28 and 34."""
    docs = spark.createDataFrame([(1, "<p>x <a href='u'></a></p>")], "doc_id long, html string")
    for job, most in ((to_entries, 34), (to_markdown, 24), (to_simple_html, 28)):
        assert _most_sorts_of_a_stage(job(docs)) <= most


def test_a_blank_run_of_text_ends_at_other_text(spark):
    """Text tokens side by side (a lone ``<`` is one) are one run, which is blank only as a whole."""
    docs = spark.createDataFrame([(1, "<p>a</p> < <p>b</p> \n<p>c</p>"), (2, "<b>x</b> <i>y</i> <p>z</p> ")], "doc_id long, html string")
    assert {r.doc_id: r.simple_html for r in to_simple_html(docs).collect()} == {
        1: "<p>a</p> &lt; <p>b</p><p>c</p>", 2: "<b>x</b> <i>y</i><p>z</p>"}
