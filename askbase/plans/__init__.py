"""Whole jobs composed of operators: ingest, answering, experiments."""
