"""Readers of source files, patches, git histories and upload messages."""
