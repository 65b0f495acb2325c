"""Writers: files, tables, run logs and published groups of outputs."""
