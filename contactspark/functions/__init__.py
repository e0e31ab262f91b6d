"""Column expressions and coordinate conversions."""
