"""Readers, writers and incremental loading."""
