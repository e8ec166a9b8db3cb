"""Structured Streaming versions of the log and cache operators."""
