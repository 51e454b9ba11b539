"""Query plans: the registered queries (Spark), their DuckDB oracles, and the synthetic payload fixtures."""
