"""Structured Streaming forms of the incremental scores."""
