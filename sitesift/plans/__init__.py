"""End-to-end jobs, the query catalog and its DuckDB oracles."""
