"""Column expressions (no actions, no joins)."""
