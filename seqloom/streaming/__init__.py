"""Streaming of the read engine."""
