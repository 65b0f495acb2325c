"""Readers: files, JDBC and named targets."""
