"""Record assembly, matching of records to statements, derived values and navigation."""
