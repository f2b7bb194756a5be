"""A PySpark engine for content-addressed deduplication."""
