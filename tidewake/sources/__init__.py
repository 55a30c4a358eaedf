"""Scans with explicit schemas and read-time checks, and partitioned sinks."""
