"""Schemas, table readers and the canonical chat views."""
