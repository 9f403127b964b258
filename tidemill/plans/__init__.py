"""Whole batch plans: materialisation, parity and point-in-time retrieval."""
