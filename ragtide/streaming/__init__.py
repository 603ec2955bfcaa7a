"""Structured Streaming forms of the aggregate operators."""
