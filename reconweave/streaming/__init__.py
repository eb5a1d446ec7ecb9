"""Structured Streaming forms of ingest, posting and detection."""
