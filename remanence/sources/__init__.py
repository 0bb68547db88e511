"""Sources of the memory engine."""
