"""Session construction and cluster-safe settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces partitions at runtime; skew-join splits hot
# partitions; the UI is a server and stays off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # A stage of the document jobs has more generated classes than the 100 that a JVM keeps by default; one that was dropped is
    # compiled again, and runs cold, in the next task. Static: it holds where the session is made, as here.
    "spark.sql.codegen.cache.maxEntries": "4000",
    # Broadcast only what is provably small: policy and rule tables are tens of rows. Anything the planner
    # cannot size stays a shuffle join.
    "spark.sql.autoBroadcastJoinThreshold": str(8 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "quire",
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only on a local master (tests, laptops) pick a
    local scratch folder when it is unset. Lineage is cut with ``checkpoint()`` or written tables there, never
    ``localCheckpoint`` (lost with an executor)."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = fallback or tempfile.mkdtemp(prefix="quire-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for intermediate tables (also used by streaming)."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name
