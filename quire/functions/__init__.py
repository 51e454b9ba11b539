"""Column-level (scalar) functions. Every one returns a ``Column`` built from ``pyspark.sql.functions``:
they run inside whole-stage codegen, never in Python."""
