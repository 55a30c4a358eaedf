"""Vessel-position and event-study analytics as PySpark DataFrame operators."""
