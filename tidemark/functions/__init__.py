"""Column functions: projection of values and the type dictionaries."""
