"""Readers of stored tables and writers that keep them up to date."""
