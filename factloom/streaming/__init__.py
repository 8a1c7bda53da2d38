"""Continuous ingest of upload messages."""
