"""Structured Streaming forms of ingest, logging and statistics."""
