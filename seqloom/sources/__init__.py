"""Sources of the read engine."""
