"""Operators on the texts of code repositories."""
