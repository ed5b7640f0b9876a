"""Structured Streaming forms of the ingest job."""
