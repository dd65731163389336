"""Readers, writers and merges of the stored tables."""
