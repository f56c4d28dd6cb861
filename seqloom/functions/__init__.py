"""Functions of the read engine."""
