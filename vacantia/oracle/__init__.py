"""DuckDB statements that compute the same results in plain SQL, for checks only."""
