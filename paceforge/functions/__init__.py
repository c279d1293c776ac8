"""Column expressions: no action, no join."""
