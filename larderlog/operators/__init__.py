"""Generic table operators; column names are arguments."""
