"""Plans of the read engine."""
