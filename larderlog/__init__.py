"""Price, catalogue, menu and promotion history analytics as Spark DataFrames."""

__version__ = "0.1.0"
