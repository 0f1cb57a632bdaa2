"""Query plans: views over the driver tables, the registered query catalog and
the DuckDB oracle SQL for each query."""
