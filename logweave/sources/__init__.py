"""Scans, derived views and sinks."""
