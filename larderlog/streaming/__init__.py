"""Structured Streaming forms of the ingest, the folds and the price queries."""
