"""Helpers shared by the operators: table loading, shared scratch tables, words and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: A word is a run of anything but ASCII white space, as the query contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    return scratch_dir(spark, f"llm/{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written to the shared folder; a lost executor cannot take it along."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that the optimizer doesn't copy into the expressions that use them."""
    df = df.withColumn("_apart", F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
    return df.select(*[F.col(c) for c in df.columns if c != "_apart" and c not in cols], *[F.col("_apart")[k].alias(k) for k in cols])


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_parts(docs: DataFrame, text: str = "text", mb: int = 16) -> int:
    """How many parts of about ``mb`` MB the whole texts fill (one pass over the column)."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, -(-total // (mb << 20)))


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Let Arrow batches end by bytes as well as by rows, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """At the end of a task: what its Python worker has freed goes back to the machine. Workers serve many tasks and stages
    and otherwise keep the most that any of them took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, whole, and where each row starts (one more entry at the end).
    Null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    array = array.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if len(array) and array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def _contracted(batches):
    """Within a partition, replace edges by a star around the smallest node of each local component."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    a, b = t["a"].to_numpy(), t["b"].to_numpy()
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = both[:len(a)], both[len(a):]
    label = np.arange(len(nodes))
    while True:  # hook the larger root to the smaller one, then halve the paths
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (before == label).all():
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``; the root is a component's smallest
    node. Nodes without an edge are not in the result.

    Large-star and small-star rounds over aggregates and joins; every round is a table in the shared folder, so
    neither the driver nor a task holds a component.
    """
    spark = edges.sparkSession
    schema = "a long, b long"
    edges = saved(edges.where("a <> b").mapInArrow(_contracted, schema), "edges")
    seen = None
    while True:
        ways = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ways.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = saved(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
