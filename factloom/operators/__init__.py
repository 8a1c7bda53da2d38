"""Operators on code-fact tables."""
