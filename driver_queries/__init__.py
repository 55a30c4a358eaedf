"""The library's operators run on the driver's tables, each with a DuckDB equivalent."""
