"""Column builders: everything stays a native expression, no Python UDF."""
