"""Canonical text of values and hashes of rows."""
