"""Structured Streaming forms of ingest, answering and progress."""
