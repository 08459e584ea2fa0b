"""Query plans over the given tables."""
