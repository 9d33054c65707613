"""Mappers and reducers."""
