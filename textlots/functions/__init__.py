"""Column functions: pure Catalyst expressions, no shuffle, no Python worker."""
