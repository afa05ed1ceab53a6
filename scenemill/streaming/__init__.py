"""Structured Streaming twins of the recurrences."""
