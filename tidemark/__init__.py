"""Keyed time-series, event-study and experiment analytics on Spark."""
