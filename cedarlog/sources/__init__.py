"""Readers, writers and the log store."""
