"""Query registry: each entry is a Spark plan ``fn(spark, sf_dir) -> DataFrame`` and, where the semantics are
expressible in SQL, its DuckDB oracle text (same output column names)."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle=None):
    """Register ``fn`` under ``name``; ``oracle`` is a zero-argument function returning DuckDB SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle()
        return fn
    return deco
