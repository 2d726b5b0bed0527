"""Readers, writers and adapters to the canonical sales table."""
