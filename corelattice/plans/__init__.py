"""Plan-level helpers: lineage cutting, size checks, row numbers."""
