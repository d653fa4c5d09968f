"""Incremental rallies with Structured Streaming."""
