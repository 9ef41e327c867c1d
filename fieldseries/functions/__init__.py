"""Column expressions: no function here looks at more than one row."""
