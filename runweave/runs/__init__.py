"""Running SQL: single queries, scripts and ordered steps."""
