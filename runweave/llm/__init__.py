"""Operators for building training corpora: filters, deduplication, sampling, tokens and search."""
