"""Plans of the memory engine."""
