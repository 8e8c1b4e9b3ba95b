"""Chunked detection over Structured Streaming."""
