"""Named query plans (Spark side) and their DuckDB oracle twins."""
