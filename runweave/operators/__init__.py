"""DataFrame to DataFrame operators over step, catalog, run and job tables."""
