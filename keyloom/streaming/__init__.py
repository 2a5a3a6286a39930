"""Incremental computations with Structured Streaming."""
