"""Column builders: pure expressions, no shuffles, no state."""
