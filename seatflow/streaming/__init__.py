"""Structured Streaming operators (T1-T8) and the slice runner."""
