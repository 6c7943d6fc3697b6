"""Column expressions: no shuffles, no Python per row."""
