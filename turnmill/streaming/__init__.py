"""Structured Streaming forms of the incremental analyses."""
