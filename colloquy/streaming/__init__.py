"""Incremental twins of the batch operators, with Structured Streaming."""
