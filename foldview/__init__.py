"""Continuously maintained, retractable views on Spark."""
