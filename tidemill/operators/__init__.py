"""Batch operators: de-duplication, rolling windows, stores and ledgers."""
