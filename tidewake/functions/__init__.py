"""Column expressions: geometry, binning, null-safe arithmetic, dates, seeded draws."""
