"""Structured Streaming forms of ingest, matching and progress."""
