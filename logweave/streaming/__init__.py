"""Structured Streaming versions of the ingest and reporting plans."""
