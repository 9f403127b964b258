"""Column expressions: validation, time and JSON forms."""
