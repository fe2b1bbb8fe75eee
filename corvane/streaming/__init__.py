"""Incremental runs by Structured Streaming."""
