"""Structured Streaming forms of the ingest, de-duplication and log operators."""
