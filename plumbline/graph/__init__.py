"""Operators over graphs that are kept as DataFrames of nodes and edges."""
