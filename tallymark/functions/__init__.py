"""Column expressions; no user functions."""
