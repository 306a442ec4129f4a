"""Operators over (series, ts_ns, value) DataFrames and over the catalog."""
