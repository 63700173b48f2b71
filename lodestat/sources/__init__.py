"""Readers and the union of sources."""
