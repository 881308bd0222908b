"""Column-level helpers: every function returns a Catalyst expression (no Python per row)."""
