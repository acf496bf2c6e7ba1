"""Fixture views and the registered query catalogue."""
