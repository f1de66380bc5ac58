"""Readers, payload normalisation, stored tables and sinks."""
