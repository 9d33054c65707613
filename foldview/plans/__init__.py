"""Descriptions of views and their lowering."""
