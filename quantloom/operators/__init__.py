"""Operators on the fact table and on results."""
