"""Structured Streaming forms of the interval summaries."""
