"""Views over the standard tables, and the queries with their DuckDB counterparts."""
