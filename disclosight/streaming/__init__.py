"""Structured Streaming forms of ingestion and burst detection."""
