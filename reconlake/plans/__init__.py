"""Plan helpers: lineage, assertions, session settings."""
