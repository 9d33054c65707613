"""Operators on changelogs, documents and orders."""
